"""shoplens — retail behaviour analytics, search and recommendation as Spark jobs.

Every public operator is a ``DataFrame -> DataFrame`` function over all users,
carts or queries at once. See README.md for the module map.
"""

__version__ = "0.1.0"
