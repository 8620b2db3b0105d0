"""The SELECT dialect: tokens, syntax tree, parser and name resolution."""
