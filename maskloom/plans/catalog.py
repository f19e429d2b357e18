"""Imports every catalog module so that all queries are registered."""

from maskloom.plans import catalog_text  # noqa: F401
from maskloom.plans import catalog_masking  # noqa: F401
from maskloom.plans import catalog_splits  # noqa: F401
from maskloom.plans import catalog_eval  # noqa: F401
from maskloom.plans import catalog_io  # noqa: F401
from maskloom.plans import catalog_learn  # noqa: F401
from maskloom.plans.catalog_masking import flagship  # noqa: F401
