"""Tables of the evaluation domain, derived by SQL from the driver's tables.

The texts run unchanged on Spark and on the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meltgrid.session import cut_lineage

CELLS = """
WITH agg AS (
  SELECT l_orderkey AS k, count(*) AS n,
         sum(cast(round(l_discount * 100) AS bigint)) AS d100,
         sum(cast(l_quantity AS bigint)) AS qty
  FROM lineitem GROUP BY l_orderkey),
reg AS (
  SELECT c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT o_orderkey AS cell_id,
       cast(floor(o_orderkey / 125) AS int) AS ri,
       cast(o_orderkey % 125 AS int) AS ci,
       1e2 * cast(o_orderkey % 125 AS int) AS x_m,
       1e2 * cast(floor(o_orderkey / 125) AS int) AS y_m,
       2e3 + cast(round(o_totalprice * 100) AS bigint) / 25e3 AS h,
       CASE WHEN o_custkey % 97 = 0 THEN 9999e0
            ELSE cast(d100 AS bigint) / (2e1 * n) END AS q,
       213e0 + (o_custkey % 90) / 1e1 AS ts,
       2e-2 + ((o_orderkey * 17) % 60) / 1e3 AS mb,
       1e0 * (o_custkey % 21) AS icevel,
       1e0 * ((o_orderkey * 7) % 11 - 5) AS vx,
       1e0 * ((o_orderkey * 13) % 11 - 5) AS vy,
       cast(qty AS bigint) / (1e0 * n) AS mean_qty,
       n_regionkey IN (0, 1) AS ispb,
       n_regionkey IN (2, 3) AS ospb,
       o_orderstatus = 'F' AS sink,
       o_custkey AS custkey
FROM orders LEFT JOIN agg ON k = o_orderkey LEFT JOIN reg ON c_custkey = o_custkey
"""

MODEL_CELLS = """
SELECT 'A' AS model, cell_id, 3e1 + mean_qty AS g, 5e0 + cell_id % 7 AS sigma,
       cast(NULL AS double) AS bmin, cast(NULL AS double) AS bmax FROM cells
UNION ALL
SELECT 'B', cell_id, 35e0 + custkey % 40, cast(NULL AS double),
       27e0 + custkey % 40, 41e0 + custkey % 40 FROM cells
UNION ALL
SELECT 'C', cell_id, 3e1 + 4e1 * ci / 124e0, cast(NULL AS double),
       cast(NULL AS double), cast(NULL AS double) FROM cells
"""

POINTS = """
SELECT c_custkey AS pid, 1e1 * ((c_custkey * 37) % 1250) AS x_m, 1e1 * ((c_custkey * 53) % 1200) AS y_m,
       -180e0 + (c_custkey * 37) % 360 AS lon, -9e1 + (c_custkey % 300) / 1e1 AS lat,
       cast(round(c_acctbal * 100) AS bigint) / 1e4 AS z
FROM customer
"""

RASTER = """
SELECT cast(p_partkey % 50 AS int) AS ix, cast(floor(p_partkey / 50) AS int) AS iy,
       25e1 * (p_partkey % 50) AS x_m, 3e2 * floor(p_partkey / 50) AS y_m,
       p_retailprice AS z
FROM part
"""

POLYGONS = """
SELECT * FROM (VALUES
  ('ISPB', 0, 0, 1000e0, 1000e0), ('ISPB', 0, 1, 6000e0, 1500e0), ('ISPB', 0, 2, 5500e0, 9000e0), ('ISPB', 0, 3, 1500e0, 8000e0),
  ('ISPB', 0, 4, cast(NULL AS double), cast(NULL AS double)),
  ('ISPB', 0, 5, 2500e0, 2500e0), ('ISPB', 0, 6, 4000e0, 2500e0), ('ISPB', 0, 7, 4000e0, 5000e0), ('ISPB', 0, 8, 2500e0, 5000e0),
  ('ISPB', 1, 0, 3000e0, 200e0), ('ISPB', 1, 1, 4500e0, 200e0), ('ISPB', 1, 2, 4500e0, 3000e0), ('ISPB', 1, 3, 3000e0, 3000e0),
  ('OSPB', 0, 0, 5000e0, 500e0), ('OSPB', 0, 1, 12000e0, 1000e0), ('OSPB', 0, 2, 11500e0, 11000e0), ('OSPB', 0, 3, 6500e0, 11500e0)
) AS t(region, part, seq, x_m, y_m)
"""

CHAIN = """
SELECT event_id AS iter, 2e1 + user_id % 130 AS mu, value - 245e0 AS a,
       -9e1 + (event_id * 7) % 181 AS theta_deg,
       1e0 - value / 5e2 AS gmean, event_type <> 'error' AS accepted
FROM events
"""

CANDIDATES = """
SELECT mu, a, theta FROM (VALUES (30e0), (40e0), (50e0), (60e0)) AS m(mu)
CROSS JOIN (VALUES (-40e0), (0e0), (40e0)) AS h(a)
CROSS JOIN (VALUES (-60e0), (0e0), (60e0)) AS t(theta)
"""

#: ``MODEL_CELLS`` as rows of each cell, so that Spark derives the cells once and not for every model; only what the
#: fields need is sent by cell, in front of the join on cells that nearly every query makes.
MODEL_CELLS_ROWS = """
SELECT model, cell_id, g, sigma, bmin, bmax FROM (
  SELECT /*+ REPARTITION(cell_id) */ cell_id, custkey, ci, mean_qty FROM cells)
LATERAL VIEW inline(array(
  named_struct('model', 'A', 'g', 3e1 + mean_qty, 'sigma', 5e0 + cell_id % 7, 'bmin', cast(NULL AS double), 'bmax', cast(NULL AS double)),
  named_struct('model', 'B', 'g', 35e0 + custkey % 40, 'sigma', cast(NULL AS double), 'bmin', 27e0 + custkey % 40, 'bmax', 41e0 + custkey % 40),
  named_struct('model', 'C', 'g', 3e1 + 4e1 * ci / 124e0, 'sigma', cast(NULL AS double), 'bmin', cast(NULL AS double), 'bmax', cast(NULL AS double)))) f
"""

TEXTS = {"cells": CELLS, "model_cells": MODEL_CELLS, "points": POINTS, "raster": RASTER,
         "polygons": POLYGONS, "chain": CHAIN, "candidates": CANDIDATES}
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_FRAMES: dict[tuple[str, str, str], DataFrame] = {}


class Tables:
    """Lazy access to the derived tables of one data folder.

    Frames (plans, not rows) are kept per application so that files are listed and schemas read
    once.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, frames: dict[tuple[str, str, str], DataFrame] | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames = _FRAMES if frames is None else frames

    def written(self) -> Tables:
        """The same tables for one query that reads the cells several times: they are derived and written once."""
        out = Tables(self.spark, self.sf_dir, {})
        out._kept("cells", lambda: cut_lineage(self.cells))
        return out

    def _kept(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in self._frames:
            self._frames[key] = build()
        return self._frames[key]

    def read(self, name: str) -> DataFrame:
        return self._kept(name, lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def _derived(self, name: str, *sources: str) -> DataFrame:
        def build() -> DataFrame:
            frames = {n: getattr(self, n) if n in TEXTS else self.read(n) for n in sources}
            for n, df in frames.items():
                df.createOrReplaceTempView(n)
            return self.spark.sql(MODEL_CELLS_ROWS if name == "model_cells" else TEXTS[name])

        return self._kept(name, build)

    @property
    def cells(self) -> DataFrame:
        return self._derived("cells", "lineitem", "customer", "nation", "orders")

    @property
    def model_cells(self) -> DataFrame:
        return self._derived("model_cells", "cells")

    @property
    def points(self) -> DataFrame:
        return self._derived("points", "customer")

    @property
    def raster(self) -> DataFrame:
        return self._derived("raster", "part")

    @property
    def polygons(self) -> DataFrame:
        return self._derived("polygons")

    @property
    def chain(self) -> DataFrame:
        return self._derived("chain", "events")

    @property
    def candidates(self) -> DataFrame:
        return self._derived("candidates")


def with_tables(*names: str) -> str:
    """``WITH`` clause defining the named derived tables for the checking engine."""
    order = ["cells", "model_cells", "points", "raster", "polygons", "chain", "candidates"]
    need = set(names) | ({"cells"} if "model_cells" in names else set())
    return "WITH " + ",\n".join(f"{n} AS ({TEXTS[n].strip()})" for n in order if n in need)
