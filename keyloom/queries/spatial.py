"""Geospatial, vector, distinct-count and range-index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import geo as G
from keyloom.operators import hll, range_index
from keyloom.operators import vectors as V
from keyloom.queries import Book
from keyloom.sources.spaces import customer_places, part_quantities, price_index, vectors
from keyloom.sources.shared import stored
from keyloom.sources.tables import read_table

book = Book()


PLACES = """p AS (SELECT c_nationkey AS key, c_custkey AS member, (c_custkey * 137.508::DOUBLE) % 360 - 180 AS lon, (c_custkey * 61.803::DOUBLE) % 180 - 90 AS lat FROM customer),
cells AS (SELECT *, least(floor((lat / 180::DOUBLE + 0.5::DOUBLE) * 4294967296::DOUBLE), 4294967295)::UBIGINT AS y0, least(floor((lon / 360::DOUBLE + 0.5::DOUBLE) * 4294967296::DOUBLE), 4294967295)::UBIGINT AS x0 FROM p),
s1 AS (SELECT *, (y0 | (y0 << 16)) & 281470681808895::UBIGINT AS y1, (x0 | (x0 << 16)) & 281470681808895::UBIGINT AS x1 FROM cells),
s2 AS (SELECT *, (y1 | (y1 << 8)) & 71777214294589695::UBIGINT AS y2, (x1 | (x1 << 8)) & 71777214294589695::UBIGINT AS x2 FROM s1),
s3 AS (SELECT *, (y2 | (y2 << 4)) & 1085102592571150095::UBIGINT AS y3, (x2 | (x2 << 4)) & 1085102592571150095::UBIGINT AS x3 FROM s2),
s4 AS (SELECT *, (y3 | (y3 << 2)) & 3689348814741910323::UBIGINT AS y4, (x3 | (x3 << 2)) & 3689348814741910323::UBIGINT AS x4 FROM s3),
s5 AS (SELECT *, (y4 | (y4 << 1)) & 6148914691236517205::UBIGINT AS y5, (x4 | (x4 << 1)) & 6148914691236517205::UBIGINT AS x5 FROM s4),
z AS (SELECT key, member, y0 & 4294967232::UBIGINT AS yc, x0 & 4294967232::UBIGINT AS xc, ((y5 >> 12) | ((x5 >> 12) << 1) | ((x5 >> 11) & 1::UBIGINT)) AS score FROM s5),
pos AS (SELECT key, member, score, (xc::DOUBLE / 4294967296::DOUBLE - 0.5::DOUBLE) * 360 + 180 / 67108864::DOUBLE AS lon, (yc::DOUBLE / 4294967296::DOUBLE - 0.5::DOUBLE) * 180 + 90 / 67108864::DOUBLE AS lat FROM z)"""


def _haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2 * 6372797.560856::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


def _geo(spark, d):
    return G.geoadd(customer_places(spark, d))


def stored_places(spark, d):
    """The customers' places, added once in a session and stored in order of their scores."""
    return stored(spark, d, "places", lambda: _geo(spark, d), "score")


@book.add(f"WITH {PLACES} SELECT key, member, score::BIGINT::DOUBLE AS score FROM z")
def geoadd_score(spark, d):
    return _geo(spark, d)


@book.add(f"WITH {PLACES} SELECT key, member, round(lon, 5) AS lon, round(lat, 5) AS lat FROM pos")
def geopos(spark, d):
    return G.geopos(_geo(spark, d)).select("key", "member", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


@book.add(f"WITH {PLACES} SELECT key, member, " + " || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', ((score::UBIGINT >> {47 - 5 * i}) & 31::UBIGINT)::INT + 1, 1)" for i in range(10)) + " || '0' AS geohash FROM z")
def geohash(spark, d):
    return G.geohash(_geo(spark, d)).select("key", "member", "geohash")


@book.add(f"WITH {PLACES} SELECT a.key, a.member AS a, b.member AS b, round({_haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000, 3) AS dist FROM pos a JOIN (SELECT key, min(member) AS m FROM pos GROUP BY key) f ON a.key = f.key JOIN pos b ON b.key = f.key AND b.member = f.m")
def geodist(spark, d):
    z = _geo(spark, d)
    first = z.groupBy("key").agg(F.min("member").alias("b"))
    pairs = z.select("key", F.col("member").alias("a")).join(first, "key")
    return G.geodist(z, pairs, "km").withColumn("dist", F.round("dist", 3))


@book.add(f"WITH {PLACES}, q AS (SELECT *, {_haversine('10.0::DOUBLE', '20.0::DOUBLE', 'lon', 'lat')} / 1000 AS dist FROM pos) SELECT key, member, round(dist, 3) AS dist FROM q WHERE dist <= 3000")
def georadius(spark, d):
    found = G.geosearch(stored_places(spark, d), 10.0, 20.0, radius=3000, unit="km")
    return found.select("key", "member", F.round("dist", 3).alias("dist"))


@book.add(f"WITH {PLACES}, q AS (SELECT *, {_haversine('10.0::DOUBLE', '20.0::DOUBLE', 'lon', 'lat')} / 1000 AS dist, row_number() OVER (PARTITION BY key ORDER BY {_haversine('10.0::DOUBLE', '20.0::DOUBLE', 'lon', 'lat')}, member) AS rn FROM pos WHERE {_haversine('10.0::DOUBLE', 'lat', 'lon', 'lat')} <= 2000000 AND {_haversine('10.0::DOUBLE', '20.0::DOUBLE', '10.0::DOUBLE', 'lat')} <= 1500000) SELECT key, member, round(dist, 3) AS dist FROM q WHERE rn <= 2")
def geosearch_box(spark, d):
    found = G.geosearch(stored_places(spark, d), 10.0, 20.0, box=(4000, 3000), unit="km", count=2)
    return found.select("key", "member", F.round("dist", 3).alias("dist"))


@book.add(f"WITH {PLACES}, q AS (SELECT *, {_haversine('10.0::DOUBLE', '20.0::DOUBLE', 'lon', 'lat')} AS dist FROM pos) SELECT 'near' AS key, member, round(dist, 2) AS score FROM q WHERE dist <= 2500000")
def geosearch_store(spark, d):
    found = G.geosearch(stored_places(spark, d), 10.0, 20.0, radius=2500000)
    return G.geosearchstore(found, "near", storedist=True).withColumn("score", F.round("score", 2))


UNIT = "u AS (SELECT vec_id AS elem, label AS key, embedding::DOUBLE[] AS v FROM embeddings)"
COS = "list_cosine_similarity({}, {})"


@book.add(f"WITH {UNIT}, q AS (SELECT v AS qv FROM u WHERE elem = 0), s AS (SELECT key, elem, {COS.format('v', 'qv')} AS score FROM u, q), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, elem) AS rn FROM s) SELECT key, elem, round(score, 6) AS score FROM r WHERE rn <= 5")
def vsim_topk(spark, d):
    v = vectors(spark, d)
    q = list(v.where("elem = 0").first()["vec"])
    return V.vsim(v, q, 5).withColumn("score", F.round("score", 6))


@book.add(f"WITH {UNIT}, q AS (SELECT v AS qv FROM u WHERE elem = 7) SELECT key, elem, round({COS.format('v', 'qv')}, 6) AS score FROM u, q ORDER BY {COS.format('v', 'qv')} DESC, elem LIMIT 10")
def vsim_elem(spark, d):
    return V.vsim_elem(vectors(spark, d), 7).withColumn("score", F.round("score", 6))


@book.add(f"WITH {UNIT} SELECT key, elem, round(list_sum(list_transform(v, lambda x: x * x)) / list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM u")
def vemb_norm(spark, d):
    e = V.vemb(vectors(spark, d))
    return e.select("key", "elem", F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("norm"), F.round(F.element_at("vec", 1), 6).alias("first"))


@book.add(f"WITH {UNIT}, s AS (SELECT a.elem AS query, b.elem AS elem, {COS.format('a.v', 'b.v')} AS score FROM u a JOIN u b ON a.elem <> b.elem WHERE a.elem % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, elem) AS rank FROM s) SELECT query, elem, round(score, 6) AS score, rank FROM r WHERE rank <= 8")
def vlinks_knn(spark, d):
    v = vectors(spark, d)
    return V.vlinks(v, v.where("elem % 100 = 0"), 8).withColumn("score", F.round("score", 6))


@book.add("SELECT label AS key, count(*) AS n, max(len(embedding)) AS dims FROM embeddings GROUP BY label")
def vcard(spark, d):
    return V.vcard(vectors(spark, d))


@book.add("SELECT label AS key, vec_id AS elem FROM embeddings WHERE NOT embedding[1] > 0")
def vrem(spark, d):
    v = vectors(spark, d)
    return V.vrem(v, v.where("vec[0] > 0")).select("key", "elem")


def _elems(spark, d):
    return read_table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("elem"))


@book.add()
def pfcount(spark, d):
    return hll.pfcount(hll.pfadd(_elems(spark, d)))


@book.add()
def pfcount_union(spark, d):
    parts = part_quantities(spark, d).select("key", F.col("member").alias("elem"))
    return hll.pfmerge(hll.pfadd(parts)).select(F.hll_sketch_estimate("sketch").alias("n"))


@book.add()
def pfmerge(spark, d):
    return hll.pfcount(hll.pfmerge(hll.pfadd(_elems(spark, d))).select(F.lit("all").alias("key"), "sketch"))


@book.add()
def hll_registers(spark, d):
    return hll.registers(_elems(spark, d))


@book.add()
def hll_estimate(spark, d):
    return hll.estimate(hll.registers(_elems(spark, d)))


def stored_index(spark, d):
    """The index of order prices, built once in a session and read as it is stored."""
    return stored(spark, d, "prices", lambda: price_index(spark, d), "k")


@book.add("SELECT printf('%010d', o_orderkey) AS k, o_totalprice AS v FROM orders WHERE printf('%010d', o_orderkey) >= '0000000100' ORDER BY k LIMIT 20")
def riscan(spark, d):
    return range_index.riscan(stored_index(spark, d), "0000000100", 20)


@book.add("SELECT printf('%010d', o_orderkey) AS k, o_totalprice AS v FROM orders WHERE printf('%010d', o_orderkey) BETWEEN '0000000500' AND '0000001500'")
def rirange(spark, d):
    return range_index.rirange(stored_index(spark, d), "0000000500", "0000001500")


QUERIES, ORACLES = book.queries, book.oracles
