"""Training-data operators: one module per operator, shared helpers in ``words``, ``store`` and ``ranks``."""
