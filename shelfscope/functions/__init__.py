"""Column functions: codes, dates, money, arrays, taxonomy text and language scores."""
