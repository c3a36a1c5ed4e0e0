"""Planning of ruleblocks."""
