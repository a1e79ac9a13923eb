"""From text to a bound statement: lexer, parser, names and access paths."""
