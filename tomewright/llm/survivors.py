"""Problem 3: one surviving record for each group of duplicates.

Groups: terms are folded to one key (case, quotes, outer signs, spaces, joiners, look-alike and invisible characters);
keys of one-word terms that differ by a slip of one letter are linked through their deletion neighbourhood, and linked
keys are joined to components by passing the smallest key along and jumping to the root's root, with the lineage cut after
each round; the rounds grow with the logarithm of a chain's length.

Survivors: values are ordered by currency. From the timestamped rows the operator learns which value follows which, and
which class of value follows which class where a pair of values is new. These precedences, freed of cycles, and the
timestamps order the values of each group in part: a value without a timestamp is later than the latest one with a
timestamp only if a precedence between the two was learned. Of those the topologically latest wins, one behind which no
other stands; without a precedence nothing is preferred but the larger key. With ``missing="earliest"`` the rows without a
timestamp stand on one place of their own, with given edges from it to all classes. Given edges enter the same order before
the learned ones, which are left out where they contradict them, and the topologically latest is looked for in the same way;
as timestamps, given edges and keys leave no two rows open then, the learned precedences are outranked everywhere.

Every choice is a ``max`` with partial aggregation over the distinct values of a group, so that a group of any size is
never gathered in one task; only classes, whose number is bounded, are listed for a group or brought to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .cuts import source_name
from .forms import LOOKALIKES

# What stands in a field instead of a value.
FILLERS = ["n/a", "na", "n.a.", "none", "null", "nil", "tbd", "tba", "todo", "unknown", "undefined", "not available", "k.a.", "xxx"]

#: Letters from which on a slip is taken for one, and copies into which the smaller side is salted for hot groups.
SLIP_LETTERS, SALT = 8, 8
#: Values that at least this share of the groups hold are classes of their own, so there are at most a hundred of them a
#: group has room for; other values go by their shape. Precedence between single values is learned for all of them.
CLASS_SHARE = 0.01
#: The place that rows without a timestamp share when it is given and not learned; no class is called so.
NO_TIME = "?"

_FROM, _TO = "".join(LOOKALIKES), "".join(LOOKALIKES.values())


@F.pandas_udf(T.StringType())
def _compat(s: pd.Series) -> pd.Series:
    """Compatibility composition, for the rows that are not plain ASCII."""
    return s.str.normalize("NFKC")


def term_key(term: Column) -> Column:
    """The key that terms share when they differ only in writing: letters, marks and digits in one form and case."""
    plain = F.when(term.rlike(r"[^\x00-\x7F]"), _compat(term)).otherwise(term)
    plain = F.translate(F.regexp_replace(plain, r"\p{Cf}", ""), _FROM, _TO)
    folded = F.lower(F.replace(F.lower(F.upper(plain)), F.lit("ß"), F.lit("ss")))
    key = F.regexp_replace(folded, r"[^\p{L}\p{M}\p{N}]+", "")
    # a term of signs only keeps them
    return F.when(key != "", key).otherwise(F.regexp_replace(plain, r"(?U)\s+", ""))


def is_one_word(term: Column) -> Column:
    """Whether a term is a single word of letters, outer signs and invisible characters aside."""
    bare = F.regexp_replace(F.regexp_replace(term, r"\p{Cf}", ""), r"(?U)\A[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+\z", "")
    return bare.rlike(r"\A[\p{L}\p{M}]+\z")


def one_slip(a: Column, b: Column) -> Column:
    """Whether two different words differ by one letter added, left out, changed, or two neighbours swapped."""
    letters = lambda c: F.split(c, "")
    apart = F.zip_with(letters(a), letters(b), lambda x, y: x != y)
    first = F.array_position(apart, True)
    i = F.when(first > 0, first).otherwise(1).cast("int")
    swapped = (F.length(a) == F.length(b)) & (F.size(F.filter(apart, lambda x: x)) == 2) & (F.substring(a, i, F.lit(2)) == F.reverse(F.substring(b, i, F.lit(2))))
    return (F.levenshtein(a, b) == 1) | ((F.levenshtein(a, b) == 2) & swapped)


def group_terms(df: DataFrame, scope: str, term: str) -> DataFrame:
    """``scope``, ``key``, ``root``: the keys of each scope's terms and the smallest key of their group."""
    base = df.select(F.col(scope).alias("scope"), F.col(term).alias("term")).filter(F.col("scope").isNotNull() & F.col("term").isNotNull())
    keys = base.select("scope", term_key(F.col("term")).alias("key"), is_one_word(F.col("term")).alias("one")).groupBy("scope", "key").agg(F.min("one").alias("one"))
    keys = cut_lineage(keys)
    words = keys.filter(F.col("one") & (F.length("key") >= SLIP_LETTERS - 1))
    cut = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.concat(F.substring(F.col("key"), F.lit(1), i - 1), F.substring(F.col("key"), i + 1, F.length("key"))))
    near = words.select("scope", "key", F.explode(F.array_distinct(F.concat(F.array("key"), cut))).alias("v"))
    pairs = near.alias("x").join(near.withColumnsRenamed({"key": "b"}).alias("y"), ["scope", "v"]).filter(F.col("key") < F.col("b"))
    pairs = pairs.select("scope", F.col("key").alias("a"), "b").distinct().filter(F.greatest(F.length("a"), F.length("b")) >= SLIP_LETTERS)
    links = cut_lineage(pairs.filter(one_slip(F.col("a"), F.col("b"))))
    both = links.select(F.col("scope").alias("s1"), F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("s1", "e.a", "e.b")
    label = links.select("scope", F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("root", F.col("key"))
    while True:
        ahead = both.join(label, (F.col("s1") == F.col("scope")) & (F.col("b") == F.col("key"))).select("scope", F.col("a").alias("key"), "root", F.lit(None).cast("string").alias("old"))
        near = label.withColumn("old", F.col("root")).unionByName(ahead).groupBy("scope", "key").agg(F.min("root").alias("root"), F.max("old").alias("old"))
        near = cut_lineage(near)
        # each key takes its root's root, so that a chain is halved at least
        jump = near.select(F.col("scope").alias("s2"), F.col("key").alias("k2"), F.col("root").alias("far"))
        new = near.join(jump, (F.col("scope") == F.col("s2")) & (F.col("root") == F.col("k2")), "left")
        new = cut_lineage(new.select("scope", "key", F.coalesce("far", "root").alias("root"), "old"))
        label = new.select("scope", "key", "root")
        if new.filter("root < old").isEmpty():
            break
    return keys.select("scope", "key").join(label, ["scope", "key"], "left").select("scope", "key", F.coalesce("root", "key").alias("root"))


def is_value(col: Column) -> Column:
    """Whether a field holds a real value: not null, blank, made of signs only, or a filler word."""
    bare = F.lower(F.regexp_replace(col, r"(?U)\A[\s\p{Cf}]+|[\s\p{Cf}]+\z", ""))
    return F.coalesce(bare.rlike(r"[\p{L}\p{N}]") & ~bare.isin(FILLERS), F.lit(False))


def value_class(col: Column) -> Column:
    """The shape of a value, in a bounded number of kinds: its writing, its joiners and its number of words, to three."""
    case = F.when(~col.rlike(r"\p{Ll}"), "A").when(~col.rlike(r"\p{Lu}"), "a").when(col.rlike(r"\A\p{Lu}\p{Ll}+\z"), "Aa").otherwise("aA")
    joint = F.when(col.rlike(r"[-_]"), "-").otherwise("")
    return F.concat(F.lit("#"), case, joint, F.least(F.lit(3), F.size(F.split(col, r"\s+"))).cast("string"))


def _transitions(nodes: DataFrame) -> DataFrame:
    """``field``, ``a``, ``b``, ``n``: in how many groups the value ``a`` was followed by ``b``, the latest one with a timestamp."""
    timed = nodes.filter("timed IS NOT NULL").select("field", "scope", "root", "v", F.col("timed.at").alias("at"))
    last = timed.groupBy("field", "scope", "root").agg(F.max(F.struct("at", "v")).alias("l"))
    salts = F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALT))))
    pairs = timed.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT))).join(last.withColumn("salt", salts), ["field", "scope", "root", "salt"])
    return pairs.filter((F.col("v") != F.col("l.v")) & (F.col("at") < F.col("l.at"))).groupBy("field", F.col("v").alias("a"), F.col("l.v").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def precedences(counts: dict[tuple[str, str], int], given: Iterable[tuple[str, str]] = ()) -> dict[str, set[str]]:
    """For each class those that come later, from the ``given`` edges and the transition ``counts``: a partial order.

    A class precedes another if more transitions lead to it than back. The given edges come first, then the strongest
    precedences, and those that would close a cycle are left out; what follows from two precedences is one as well.
    """
    net = sorted(((n - counts.get((b, a), 0), a, b) for (a, b), n in counts.items() if n > counts.get((b, a), 0)), key=lambda x: (-x[0], x[1], x[2]))
    later: dict[str, set[str]] = {}
    for a, b in [*given, *((a, b) for _, a, b in net)]:
        if a == b or a in later.get(b, ()):
            continue
        gained = {b} | later.get(b, set())
        for x in [a, *(x for x in later if a in later[x])]:
            later.setdefault(x, set()).update(gained)
    return later


def _learned(nodes: DataFrame, missing: str) -> tuple[DataFrame, DataFrame]:
    """``field``, ``a``, ``b``, ``later`` for pairs of values, and ``field``, ``class``, ``after`` for the classes; ``nodes`` has a ``class``.

    With ``missing="earliest"`` the order of the classes has :data:`NO_TIME` before each of them.
    """
    pairs = cut_lineage(_transitions(nodes))
    back = pairs.select("field", F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("m"))
    both = pairs.join(back, ["field", "a", "b"], "full").select("field", "a", "b", (F.coalesce("n", F.lit(0)) > F.coalesce("m", F.lit(0))).alias("later"))
    names = nodes.select("field", "v", "class").distinct()
    classed = pairs.join(names.withColumnsRenamed({"v": "a", "class": "x"}), ["field", "a"]).join(names.withColumnsRenamed({"v": "b", "class": "y"}), ["field", "b"])
    counts: dict[int, dict[tuple[str, str], int]] = {}
    for r in classed.filter("x != y").groupBy("field", "x", "y").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["field"], {})[r["x"], r["y"]] = r["n"]
    given: dict[int, list[tuple[str, str]]] = {}
    if missing == "earliest":
        for r in names.select("field", "class").distinct().toLocalIterator():
            given.setdefault(r["field"], []).append((NO_TIME, r["class"]))
    rows = [(f, c, sorted(after)) for f in sorted({*counts, *given}) for c, after in precedences(counts.get(f, {}), given.get(f, ())).items()]
    return both, nodes.sparkSession.createDataFrame(rows, "field int, class string, after array<string>")


def _with_class(nodes: DataFrame) -> DataFrame:
    groups = nodes.select("field", "scope", "root").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("groups"))
    common = nodes.groupBy("field", "v").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(groups), "field")  # a row a field
    common = common.filter((F.col("n") >= 3) & (F.col("n") >= CLASS_SHARE * F.col("groups"))).select("field", "v", F.lit(True).alias("common"))
    return nodes.join(common, ["field", "v"], "left").withColumn("class", F.when(F.col("common"), F.concat(F.lit("="), "v")).otherwise(value_class(F.col("v")))).drop("common")


def latest_values(rows: DataFrame, missing: str) -> DataFrame:
    """``scope``, ``root``, ``field``, ``v``, ``id``: the survivor of each group and field.

    ``rows`` has ``scope``, ``root``, ``field``, ``v`` (a real value), ``id``, ``trust``, ``at``. Only values of the group's
    highest trust are candidates; the order among them is that of the module's docstring.
    """
    timed = F.max(F.when(F.col("at").isNotNull(), F.struct("trust", "at", "id"))).alias("timed")
    untimed = F.max(F.when(F.col("at").isNull(), F.struct("trust", "id"))).alias("untimed")
    nodes = rows.groupBy("field", "scope", "root", "v").agg(timed, untimed)
    nodes = cut_lineage(_with_class(cut_lineage(nodes)))
    where = ["field", "scope", "root"]
    t = F.max(F.when(F.col("timed").isNotNull(), F.struct("timed.trust", "timed.at", "timed.id", "v"))).alias("t")
    tops = nodes.groupBy(*where).agg(t, F.max("untimed.trust").alias("u_trust")).withColumn("top", F.greatest("t.trust", "u_trust"))
    salts = F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALT))))
    asking = nodes.filter("untimed IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)))
    asking = asking.join(tops.withColumn("salt", salts), [*where, "salt"]).filter(F.col("untimed.trust") == F.col("top"))
    # rivals: the latest value with a timestamp, if it has as much trust
    asking = asking.select(*where, "v", F.col("untimed.id").alias("id"), F.when(F.col("t.trust") == F.col("top"), F.col("t.v")).alias("rival"), "class")
    # where a value without a timestamp stands in the order: by itself and its class, or on the given place
    own, place = (F.lit(None).cast("string"), F.lit(NO_TIME)) if missing == "earliest" else (F.col("v"), F.col("class"))
    asking = asking.withColumns({"own": own, "place": place}).drop("class")
    pairs, after = _learned(nodes, missing)
    known = pairs.select("field", F.col("a").alias("rival_"), F.col("b").alias("own"), "later")
    # rows without a rival ask for nothing and get a key of their own
    alone = F.coalesce("rival", F.concat(F.lit("#"), F.col("id").cast("string")))
    asking = asking.withColumn("rival_", alone).join(known, ["field", "rival_", "own"], "left").drop("rival_")
    small = F.broadcast(after.withColumnRenamed("class", "place"))  # at most a row for each class
    asking = asking.join(small, ["field", "place"], "left")
    shape = nodes.select("field", F.col("v").alias("rival_"), F.col("class").alias("r_class")).distinct()
    asking = asking.withColumn("rival_", alone).join(shape, ["field", "rival_"], "left").drop("rival_")
    asking = asking.join(small.withColumnsRenamed({"place": "r_class", "after": "r_after"}), ["field", "r_class"], "left")
    beats = F.coalesce("later", F.array_contains("r_after", F.col("place")), F.lit(False))
    asking = cut_lineage(asking.filter(F.col("rival").isNull() | beats).select(*where, "v", "id", "place", F.coalesce("after", F.array().cast("array<string>")).alias("after")))
    there = asking.groupBy(*where).agg(F.collect_set("place").alias("places"))  # bounded: classes, not values
    asking = asking.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT))).join(there.withColumn("salt", salts), [*where, "salt"])
    asking = asking.filter(~F.arrays_overlap("after", "places"))
    won = asking.groupBy(*where).agg(F.max(F.struct("id", "v")).alias("u"))
    won = tops.join(won, where, "left")
    use = F.col("u").isNotNull()
    return won.select("scope", "root", "field", F.when(use, F.col("u.v")).otherwise(F.col("t.v")).alias("v"), F.when(use, F.col("u.id")).otherwise(F.col("t.id")).alias("id"))


def survivors(df: DataFrame, scope: str, term: str, key: str, fields: list[str], origin: str, recorded: str, trust: DataFrame, missing: str = "earliest") -> DataFrame:
    """One row for each group: ``scope``, ``root``, ``rows``, ``first_<key>``, ``term``, and for each field the surviving value and ``<field>_<key>``.

    A field's survivor has a real value and, among those, the highest trust of its origin (``trust`` has ``origin`` and
    ``trust``; a null or unknown origin counts 0), then the latest timestamp, then the largest ``key``. Rows without a
    timestamp come first with ``missing="earliest"``, by given edges of the same order; with ``"learned"`` the topologically latest of them wins over the
    latest row with a timestamp, at equal trust, if a learned precedence puts its value behind; see the module's
    docstring. A group without a real value has null and 0. Rows with null scope or term belong to no group. Tied and
    repeated rows are settled by ``key``, which is unique.
    """
    cols = {scope: "scope", term: "term", key: "id", origin: "origin", recorded: "at"}
    base = df.select(*(F.col(a).alias(b) for a, b in cols.items()), *(F.col(f).alias(f"v_{i}") for i, f in enumerate(fields)))
    base = base.filter(F.col("scope").isNotNull() & F.col("term").isNotNull())
    known = trust.select(source_name(F.col("origin")).alias("o2"), F.col("trust").alias("trust")).groupBy("o2").agg(F.max("trust").alias("trust"))
    rows = base.withColumn("o", source_name(F.col("origin"))).join(known, F.col("o") == F.col("o2"), "left").withColumn("trust", F.coalesce("trust", F.lit(0))).drop("o", "o2", "origin")
    groups = group_terms(df, scope, term)
    # used for the groups and for their values
    rows = cut_lineage(rows.withColumn("key", term_key(F.col("term"))).join(groups, ["scope", "key"]))
    clean = ~F.col("term").rlike(r"\p{Cf}|[^\x00-\x7F]&&[^\p{L}\p{M}]") & (F.col("term") == F.regexp_replace("term", r"(?U)\A[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", ""))
    plain = ~F.col("term").rlike(r"[Ѐ-ӿͰ-Ͽ＀-￯]")
    best = F.max_by("term", F.struct(clean & plain, "trust", F.col("at").isNotNull(), "at", "id")).alias("best_term")
    done = rows.groupBy("scope", "root").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias(f"first_{key}"), best)
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"v_{i}").alias("v")) for i in range(len(fields)))))
    long = rows.select("scope", "root", "id", "trust", "at", values.alias("x")).select("scope", "root", "id", "trust", "at", "x.field", "x.v").filter(is_value(F.col("v")))
    won = latest_values(long, missing).groupBy("scope", "root").agg(*(F.max(F.when(F.col("field") == i, F.struct("v", "id"))).alias(f"w_{i}") for i in range(len(fields))))
    chosen = []
    for i, f in enumerate(fields):
        chosen += [F.col(f"w_{i}.v").alias(f), F.coalesce(F.col(f"w_{i}.id"), F.lit(0)).cast("long").alias(f"{f}_{key}")]
    return done.join(won, ["scope", "root"], "left").select(F.col("scope").alias(scope), "root", "rows", f"first_{key}", F.col("best_term").alias(term), *chosen)
