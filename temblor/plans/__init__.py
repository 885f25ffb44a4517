from . import registry  # noqa: F401  (any plan can be imported first)
