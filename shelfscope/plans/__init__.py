"""The analyses: displacement, attribution, exposure, impact, rank evaluation, keywords, language, inventory."""
