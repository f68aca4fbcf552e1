"""sheetwise: wide yearly report sheets -> tidy tables, on Spark.

Pure ``DataFrame -> DataFrame`` functions, grouped as

* ``sources``   -- sheet rows / header dimension / workbooks / run-log import
* ``functions`` -- column expressions (text normalization, safe casts, header grammars)
* ``operators`` -- reshaping, regrouping, ordinals, lookups, analytics, run-log folds, catalog
* ``plans``     -- the five output tables and the stage job
* ``sinks``     -- CSV / JSON / text writers and the publish manifest
* ``streaming`` -- incremental normalization of newly landed sheet rows
"""

from sheetwise.session import get_session  # noqa: F401
