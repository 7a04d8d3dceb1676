"""Product versions of up to four numbers with a stage before release, and ranges of them, as arrays that compare in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stages before a release, from the earliest.
STAGES = ("nightly", "dev", "alpha", "beta", "rc")
RELEASE = len(STAGES)
_VERSION = r"(?i)^v?(\d{1,9}(?:\.\d{1,9}){0,3})(?:[- .]?(alpha|beta|rc|dev|nightly)(?:[-.]?(\d{1,9}))?)?(?:\s+(LTS))?(?:\+[\w.-]+)?$"
_COMPARISON = r"(?i)^(>=|<=|>|<|=|\^|~)?(v?\d{1,9}(?:\.(?:\d{1,9}|x|\*)){0,3}(?:[-.]?(?:alpha|beta|rc|nightly|dev)(?:[-.]?\d{1,9})?)?)$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What ``body`` makes of a value that it names more than once: so it is planned and worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda p: p.try_cast("bigint"))


def _padded(numbers: Column) -> Column:
    """Four numbers."""
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("bigint"), 4)), 1, 4)


def version_key(version: Column) -> Column:
    """Six numbers that compare as versions do: four of the version, its stage (a release after all of ``STAGES``), the stage's iteration; null if it can't be read."""
    t = F.trim(version)
    stage = F.lower(F.regexp_extract(t, _VERSION, 2))
    rank = F.when(stage == "", RELEASE).otherwise(F.array_position(F.array(*map(F.lit, STAGES)), stage).cast("int") - 1)
    tail = F.array(rank.cast("bigint"), F.coalesce(F.regexp_extract(t, _VERSION, 3).try_cast("bigint"), F.lit(0)))
    return F.when((F.length(version) <= 80) & t.rlike(_VERSION), F.concat(_padded(_numbers(F.regexp_extract(t, _VERSION, 1))), tail))


def staged_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two versions; null if either can't be read."""
    x, y = version_key(a), version_key(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def _tests(token: Column) -> Column:
    """The comparisons that one token of a range stands for: (op, key), where op is one of >=, <=, >, <, = and ~ (the numbers that aren't null are the same); null if it can't be read."""
    test = lambda o, k: F.array(F.named_struct(F.lit("op"), o, F.lit("key"), k))

    def below(op: Column, key: Column) -> Column:
        """The first key after those that ^ and ~ mean."""
        # the first number that counts: the second for ~, the first that isn't 0 for ^, the third if all are
        leading = F.array_position(F.transform(F.slice(key, 1, 4), lambda x: x != 0), True).cast("int")
        at = F.when(op == "~", 2).otherwise(_let(leading, lambda n: F.when(n == 0, 3).otherwise(n)))
        bumped = _let(at, lambda n: F.transform(F.slice(key, 1, 4), lambda x, i: F.when(i + 1 < n, x).when(i + 1 == n, x + 1).otherwise(F.lit(0).cast("bigint"))))
        return F.concat(bumped, F.array(F.lit(RELEASE).cast("bigint"), F.lit(0).cast("bigint")))

    def plain(op: Column, key: Column) -> Column:
        return F.when(op.isin("^", "~"), F.concat(test(F.lit(">="), key), test(F.lit("<"), below(op, key)))).otherwise(test(F.when(op == "", "=").otherwise(op), key))

    def read(op: Column, text: Column) -> Column:
        numbers, any_number = _numbers(F.regexp_replace(text, r"(?i)^v", "")), text.rlike(r"(?i)[.](x|\*)")
        return F.when(~any_number, _let(version_key(text), lambda key: plain(op, key))).when(op.isin("", "="), test(F.lit("~"), numbers))

    part = lambda n: F.regexp_extract(token, _COMPARISON, n)
    return F.when(token.rlike(_COMPARISON), _let(part(1), lambda op: _let(part(2), lambda text: read(op, text))))


def range_tests(wanted: Column) -> Column:
    """A range such as ``>=1.2 <2 || 3.x`` as alternatives: (tests, staged), staged where one of them names a stage; tests null where one can't be read.

    To be taken once for each rule and then asked with ``satisfies`` for each version. ``*`` is every release. Null, empty and ``unknown`` are null.
    """
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(wanted), "[«»]", ""), r"(?i)\s+LTS\b", ""), r"(?i)exact\s+", "=")
    clean = F.regexp_replace(clean, r"(>=|<=|>|<|=|\^|~)\s+", "$1")

    def alternative(text: Column) -> Column:
        found = F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), _tests)
        staged = lambda whole: F.exists(whole, lambda t: (t["op"] != "~") & (F.get(t["key"], 4) < RELEASE) & (t["op"] != ""))
        whole = _let(found, lambda f: F.when((F.size(f) > 0) & ~F.exists(f, lambda t: t.isNull()), F.flatten(f)))
        return _let(whole, lambda w: F.named_struct(F.lit("tests"), w, F.lit("staged"), F.coalesce(staged(w), F.lit(False))))

    no_tests = F.array().cast("array<struct<op: string, key: array<bigint>>>")
    everything = F.array(F.named_struct(F.lit("tests"), no_tests, F.lit("staged"), F.lit(False)))
    return F.when(F.trim(wanted) == "*", everything).when((wanted != "") & (wanted != "unknown"), F.transform(F.split(clean, r"\s*\|\|\s*"), alternative))


def satisfies(key: Column, tests: Column) -> Column:
    """Whether a ``version_key`` lies in the range of ``range_tests``; null if either can't be read, and where only what can't be read might hold. A version before release lies only in ranges that name a stage."""

    def holds(t: Column) -> Column:
        op, k = t["op"], t["key"]
        same = F.forall(F.transform(k, lambda x, i: x.isNull() | (x == F.get(key, i))), lambda x: x)
        return F.when(op == ">=", key >= k).when(op == "<=", key <= k).when(op == ">", key > k).when(op == "<", key < k).when(op == "=", key == k).otherwise(same)

    found = F.exists(tests, lambda a: a["tests"].isNotNull() & F.forall(a["tests"], holds) & ((F.get(key, 4) == RELEASE) | a["staged"]))
    unread = F.exists(tests, lambda a: a["tests"].isNull())
    return F.when(key.isNull() | tests.isNull(), F.lit(None).cast("boolean")).when(found, True).when(unread, F.lit(None).cast("boolean")).otherwise(False)
