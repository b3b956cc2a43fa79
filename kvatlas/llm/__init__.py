"""Operators for preparing training data. Nothing else in kvatlas imports this subpackage."""
