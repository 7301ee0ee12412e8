"""The registered queries. The catalogue loads all modules, in the order in which they build on each other."""

import corpusloom.catalog  # noqa: F401
