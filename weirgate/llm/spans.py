"""Native span extraction; see :mod:`weirgate.functions.spans`."""

from weirgate.functions.spans import SPAN, by_kind, by_start, find, none, of_kind, replace, show

__all__ = ["SPAN", "by_kind", "by_start", "find", "none", "of_kind", "replace", "show"]
