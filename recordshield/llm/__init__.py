"""Operators for preparing training corpora; see the module of each operator for its rules and defined cases."""
