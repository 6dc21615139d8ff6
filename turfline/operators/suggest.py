"""Bulk typeahead: the best voters for every free-text query."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turfline import fixed
from turfline.functions.people import standardize
from turfline.functions.text import basic, words
from turfline.operators.ordering import first_in_group
from turfline.session import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SHAPE = ["first", "middle", "last", "street", "number", "active"]
#: People shapes and queries that meet in one task.
SHAPES_PER_TASK = 200_000
QUERIES_PER_TASK = 10_000


class _Words:
    """The words of one field: for a typed word the shapes that hold it, and those that hold a word beginning with it."""

    def __init__(self, lists: list[list[str]]):
        at = np.fromiter((i for i, ws in enumerate(lists) for _ in ws), np.int64)
        held = [w for ws in lists for w in ws]
        self.words = sorted(set(held))
        number = {w: n for n, w in enumerate(self.words)}
        code = np.fromiter((number[w] for w in held), np.int64, len(held))
        self.shapes = at[np.argsort(code, kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(self.words))))).astype(np.int64)

    def give(self, typed: str, points: np.ndarray) -> bool:
        """Raise the points of the shapes that ``typed`` hits: to 2 by a prefix, to 3 by the word itself."""
        low = bisect_left(self.words, typed)
        high = bisect_left(self.words, typed + chr(sys.maxunicode), low)
        hits = self.shapes[self.starts[low]:self.starts[high]]
        points[hits] = np.maximum(points[hits], 2)
        if low < high and self.words[low] == typed:
            points[self.shapes[self.starts[low]:self.starts[low + 1]]] = 3
        return low < high


def _best_shapes(limit: int, passed_over: frozenset) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best ``limit`` shapes of one block for each of some queries: by score, then by their earliest voter."""

    def best(asked: pa.Table, shapes: pa.Table) -> pa.Table:
        query, shape, score = [], [], []
        shapes = shapes.take(pc.sort_indices(shapes, sort_keys=[("_first", "ascending")], null_placement="at_start"))
        names = [[w for w in ws if w] for ws in zip(*(shapes[c].to_pylist() for c in ("first", "middle", "last")))]
        streets = [[w for w in (line or "").split(" ") if w and w not in passed_over] for line in shapes["street"].to_pylist()]
        fields = _Words(names), _Words(streets)
        houses = _Words([[n] if n else [] for n in shapes["number"].to_pylist()])
        active = pc.fill_null(shapes["active"], False).to_numpy().astype(np.int32)
        n = len(shapes)
        for row, typed, numbers in zip(range(len(asked)), asked["typed"].to_pylist(), asked["numbers"].to_pylist()):
            at: dict[int, list[str]] = {}
            for t in typed or ():
                at.setdefault(t["at"], []).append(t["word"])
            small = np.uint8 if len(at) <= 20 else np.int32  # 12 points a word and 9 fit
            totals = []
            for field in fields:
                total = np.zeros(n, small)
                for alike in at.values():
                    points = np.zeros(n, small)
                    if any([field.give(w, points) for w in alike]):
                        total += points
                totals.append(total)
            house = np.zeros(n, small)
            for number in numbers or ():
                low = bisect_left(houses.words, number)
                if low < len(houses.words) and houses.words[low] == number:
                    house[houses.shapes[houses.starts[low]:houses.starts[low + 1]]] = 1
            name, street = totals
            twice = (2 * (name + street + 4 * house) + active.astype(small)) * ((name > 0) | ((house > 0) & (street > 0)))
            left, level = limit, int(twice.max(initial=0))
            while left > 0 and level > 0:
                these = np.flatnonzero(twice == level)[:left]
                query.append(np.full(len(these), row))
                shape.append(these)
                score.append(np.full(len(these), level / 2))
                left -= len(these)
                level = int(twice[twice < level].max(initial=0))
        rows, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (query, shape))
        scores = np.concatenate(score) if score else np.zeros(0)
        taken = shapes.select(["shape", "_first"]).take(found)
        return pa.table([asked["query_id"].take(rows), taken["shape"], taken["_first"], pa.array(scores, pa.float64())], names=["query_id", "shape", "_first", "score"])

    return best


def suggest_voters(queries: DataFrame, roll: DataFrame, limit: int = fixed.SUGGEST_TOP) -> DataFrame:
    """Top voters per query (query_id, query).

    An exact word scores 3, a prefix 2, the house number 4, an active voter half a point more.  A voter
    needs a name hit, or the house number together with a distinctive street word.  Queries meet blocks of distinct people shapes: a task
    indexes the words of its block, adds up the points of its queries and hands on the best shapes of each, so the many hits of a frequent
    word are never rows.  Only the ranked shapes become voters.
    """
    std = standardize(roll).withColumn("active", F.coalesce(F.col("status") == "active", F.lit(False)))
    people = stage(std.select("row_pos", "id", *_SHAPE), "voters")
    first = F.when(F.count_if(F.col("row_pos").isNull()) == 0, F.min("row_pos")).alias("_first")
    shapes = stage(people.dropna(subset=_SHAPE).groupBy(*_SHAPE).agg(first).withColumn("shape", F.monotonically_increasing_id()), "shapes")  # a number as key of all joins
    keyed = people.join(shapes, _SHAPE).select("shape", "row_pos", "id")
    each = queries.select("query_id", F.posexplode(words(basic("query"))).alias("at", "word")).where("length(word) >= 2")
    number = F.col("word").rlike("^\\d+$")
    asked = stage(each.groupBy("query_id").agg(
        F.collect_set(F.when(~number, F.struct("at", "word"))).alias("typed"),
        F.collect_set(F.when(number & F.col("query_id").isNotNull(), F.col("word"))).alias("numbers")).where("size(typed) > 0"), "asked")
    blocks, deals = max(1, -(-shapes.count() // SHAPES_PER_TASK)), max(1, -(-asked.count() // QUERIES_PER_TASK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.withColumn("_deal", F.pmod(F.xxhash64("query_id"), F.lit(deals)).cast("int")).withColumn("_block", every(blocks))
    b = shapes.withColumn("_block", F.pmod(F.xxhash64("shape"), F.lit(blocks)).cast("int")).withColumn("_deal", every(deals))
    key = ["_block", "_deal"]
    schema = T.StructType([asked.schema["query_id"], shapes.schema["shape"], shapes.schema["_first"], T.StructField("score", T.DoubleType())])
    ranked = a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(_best_shapes(limit, frozenset(fixed.STREET_WORDS)), schema)
    ranked = first_in_group(ranked, ["query_id"], [F.desc("score"), F.col("_first")], limit)
    # A shape has at most ``limit`` useful voters, its earliest ones.
    earliest = first_in_group(keyed.select("shape", "row_pos", "id"), ["shape"], ["row_pos"], limit).drop("rank")
    voters = ranked.select("query_id", "shape", "score").join(earliest, "shape")
    return first_in_group(voters, ["query_id"], [F.desc("score"), F.col("row_pos")], limit).select(
        "query_id", "rank", "id", "score")
