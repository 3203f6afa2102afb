"""Column expressions: keys, feature sets, labels, split names, number formats."""
