"""The registered queries of the core engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.operators import snapshots
from quern.plans import code, retrieval, text
from quern.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "snippets"), table(spark, d, "versions"))


QUERIES: dict[str, Query] = {"p3_found": p3_found} | text.QUERIES | retrieval.QUERIES | code.QUERIES

ORACLES: dict[str, str] = {
    "p3_found": """
      WITH v AS (SELECT version, row_number() OVER (ORDER BY built_at, version) AS o FROM (SELECT version, max(built_at) AS built_at FROM versions GROUP BY 1)),
      h AS (SELECT id, version, loaded_at, coalesce(nullif(lower(trim(hash, ' ' || chr(9) || chr(10) || chr(13))), ''), sha256(content), 'null content') AS h FROM snippets),
      c AS (SELECT id, o, h FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id, version ORDER BY loaded_at DESC, h DESC) = 1) JOIN v USING (version)),
      e AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.o + 1, b.o) AS o,
                   CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' END AS change
            FROM c a FULL JOIN c b ON a.id = b.id AND b.o = a.o + 1)
      SELECT version, id, change FROM e JOIN v USING (o) WHERE change IS NOT NULL AND o > 1""",
} | text.ORACLES | retrieval.ORACLES | code.ORACLES
