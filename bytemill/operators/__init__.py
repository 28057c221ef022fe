"""All operators; importing the package registers their queries."""

from ..sources import checked  # noqa: F401
from . import collection, datasets, difference, fusion, history, listing, metrics, profile, records, retention, submission, tables, verification  # noqa: F401
