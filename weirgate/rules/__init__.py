"""Detection rules: what is looked for, as data, and the checks that a rule set must pass."""
