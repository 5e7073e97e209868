"""Column expressions: text, amounts, dates, vendors, checks. All run in the JVM."""
