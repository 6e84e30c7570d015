"""Column functions and the rule tables they run on."""
