"""Search plans: validation, compilation to a column, wording, and the language front end."""
