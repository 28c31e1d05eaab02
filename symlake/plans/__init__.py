"""plans of the code-symbol engine."""

from symlake.plans import build_catalog  # noqa: F401 its queries join those of catalog
