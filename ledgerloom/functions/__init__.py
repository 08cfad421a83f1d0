"""Column functions: text, money and dates. Built-in expressions only."""
