"""Column functions: text, rules, similarity, reply parsing."""
