r"""Personal data: candidate spans scored by gradient boosting, with DataFrame functions only.

Generators of two kinds propose spans. The strict ones are the base patterns (email, ip, card, phone); a strict match
that passes its check is a base span and always stays. The loose ones (:data:`LOOSE`, several a kind) propose more, and
may overlap: other separators, spelled-out "(at)" and "(dot)", numbers without a plus sign, one of two card numbers that
the base pattern reads as one, long strings of letters and digits that may be secrets. Each loose candidate gets small
integer features of its format and of the text around it, and a label from other evidence than these: whether it
overlaps a base span of its kind; for a secret, whether a word like token or password is assigned to it. Candidates are
counted by feature cell (at most :data:`MOST_CELLS` cells, whatever the input); boosted depth-two trees with logistic
loss are fitted to all counts. Five further models, each of the documents of four of five folds, score the fifth; on
these scores a threshold for each kind is set, the lowest at or over which the share of labelled candidates is at least
``precision``. Trees become one SQL expression. Candidates at or over their threshold that overlap no base span are
added, labelled or not, of overlapping ones the best.

Patterns are matched leftmost and without overlap for each pattern. The lookbehind and the possessive
quantifiers in them change no match; they keep matching linear on long runs.

Null and empty texts have no spans. Positions count code points, ends are exclusive. Repeated rows give repeated
results. An empty table, or one whose candidates are all of one class, adds nothing to the base. :func:`redact` carries
all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import keep

KINDS = ("email", "ip", "card", "phone")
#: Base kinds, and those that only the trees can add.
ALL_KINDS = (*KINDS, "secret")
FOLDS = 5
#: Strict patterns, and loose ones.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": [r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]++(?:(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?)[A-Za-z0-9-]++)++"],
    "ip": [r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\x20\.\x20?)[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}(?![0-9])", r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[\x20./_-][0-9]{4}){3})(?![0-9])"],
    "phone": [r"(?<![0-9+])\+?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){2,4}(?![0-9])"],
    "secret": [r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+=*+"],
}
#: A text without this has no candidate of the kind.
NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]", "secret": "[0-9]"}
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|addr|login",
    "card": "card|visa|pay|credit|account",
    "phone": "phone|tel|call|mobile|fax|dial",
}
#: Before a secret: the evidence that labels it, which is no feature of it.
ASSIGNED = r"(token|secret|key|passw[a-z]*|pwd|auth|credential)[a-z_]*\s*[=:]+\s*[\"']?$"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
FEATURES = {"kind": 5, "digits": 5, "valid": 2, "seps": 3, "left": 3, "right": 3, "context": 2}
MOST_CELLS = 2 * FOLDS * math.prod(FEATURES.values())


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid(kind: str, v: Column) -> Column:
    """The check that a strict match of the kind must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return v.rlike(OCTETS)
    n = F.length(_digits(v))
    return n.between(12, 19) & F.call_function("luhn_check", _digits(v)) if kind == "card" else n.between(9, 15)


def _found(text: Column, pattern: str, when: Column) -> Column:
    """Matches as an array of (s, e, v): lengths of what lies between them and of the matches are added up."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), values.alias("v"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["v"]), F.lit(0))).alias("at"),
        F.when(
            x["v"].isNotNull(),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("s"), (acc["at"] + F.length(x["gap"]) + F.length(x["v"])).alias("e"), x["v"].alias("v")))),
        )
        .otherwise(acc["out"])
        .alias("out"),
    )
    none = F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(when & F.regexp_like(text, F.lit(pattern)), F.aggregate(both, start, step, lambda acc: acc["out"])).otherwise(none)


def _overlaps(spans: Column, s: Column, e: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < e) & (s < b["e"]))


def _before(text: Column, x: Column) -> Column:
    return F.when(x["s"] > 0, F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))).otherwise(F.lit(""))


def _features(kind: str, text: Column, x: Column) -> Column:
    v, code = x["v"], ALL_KINDS.index(kind)
    digits = F.length(_digits(v))
    before, after = _before(text, x), F.substring(text, x["e"] + 1, F.lit(1))
    edge = lambda c: F.when(c.rlike(r"[A-Za-z0-9]"), 1).when((c == "") | c.rlike(r"[\s.,;:!?()]"), 0).otherwise(2)
    if kind == "secret":  # here the number of separators is a class of length, and validity is being hexadecimal
        n = F.length(v)
        seps, valid = F.when(n < 24, 0).when(n < 40, 1).otherwise(2), v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        context = F.lit(0)
    else:
        seps = F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(v, r"[A-Za-z0-9%+]", ""), ""), lambda c: c != "")))
        valid = v.rlike(r"\.[A-Za-z]{2,6}$") if kind == "email" else F.regexp_replace(v, r"[^0-9.]", "").rlike(OCTETS) if kind == "ip" else _valid(kind, v)
        context = F.lower(before).rlike(CONTEXT[kind]).cast("int")
    return F.struct(
        F.lit(code).alias("kind"),
        F.when(digits < 9, 0).when(digits < 12, 1).when(digits < 16, 2).when(digits == 16, 3).otherwise(4).alias("digits"),
        valid.cast("int").alias("valid"),
        F.least(seps, F.lit(2)).alias("seps"),
        edge(F.substring(before, -1, 1)).alias("left"),
        edge(after).alias("right"),
        context.alias("context"),
    )


def _passes(kind: str):
    return lambda x: _valid(kind, x["v"])


def _span(kind: str):
    return lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def _candidate(kind: str, text: Column, base: Column | None):
    labelled = (lambda x: _overlaps(base, x["s"], x["e"])) if base is not None else (lambda x: F.lower(_before(text, x)).rlike(ASSIGNED))
    return lambda x: F.struct(F.lit(ALL_KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), labelled(x).cast("int").alias("label"), _features(kind, text, x).alias("f"))


def candidates(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: the row itself as a struct, fold, text, base (kind, s, e) and loose (kind, s, e, label, features)."""
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), fold.alias("fold"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    out = rows.withColumns({f"has_{k}": text.rlike(need) for k, need in (("email", NEEDS["email"]), ("digit", "[0-9]"))})
    has = lambda k: F.col("has_email" if k == "email" else "has_digit")
    out = out.withColumns({f"s_{k}": _found(text, STRICT[k], has(k)) for k in KINDS} | {f"l_{k}": F.array_distinct(F.concat(*[_found(text, p, has(k)) for p in LOOSE[k]])) for k in ALL_KINDS})
    out = out.withColumns({f"b_{k}": F.filter(f"s_{k}", _passes(k)) for k in KINDS})
    out = out.withColumn("l_secret", F.filter("l_secret", lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]")))
    base = F.concat(*[F.transform(f"b_{k}", _span(k)) for k in KINDS])
    loose = F.concat(*[F.transform(f"l_{k}", _candidate(k, text, F.col(f"b_{k}") if k in KINDS else None)) for k in ALL_KINDS])
    return out.select("row", "fold", "text", base.alias("base"), loose.alias("loose"))


def cell_counts(found: DataFrame) -> list:
    """Counts of candidates by feature cell, label and fold; a bounded number of rows."""
    rows = found.where(F.size("loose") > 0).select("fold", F.explode("loose").alias("c"))
    return rows.groupBy("fold", "c.label", *[F.col(f"c.f.{f}").alias(f"f_{f}") for f in FEATURES]).count().collect()


class Boosted:
    """Depth-two trees on tests "feature equals value", fitted to cell counts by Newton steps."""

    def __init__(self, cells: list, without: int | None = None, rounds: int = 24, rate: float = 0.3, ridge: float = 1.0):
        """``without``: a fold to leave out."""
        sums: dict[tuple, int] = {}
        for c in cells:
            if c["fold"] != without:
                key = (tuple(c[f"f_{f}"] for f in FEATURES), c["label"])
                sums[key] = sums.get(key, 0) + c["count"]
        train = [(x, y, n) for (x, y), n in sorted(sums.items())]
        self.trees, self.base = [], 0.0
        good, bad = (sum(n for _, y, n in train if y == side) for side in (1, 0))
        self.fitted = bool(good and bad)
        if not self.fitted:
            return
        self.base = math.log(good / bad)
        tests = [(i, v) for i, size in enumerate(FEATURES.values()) for v in range(size)]
        score = [self.base] * len(train)

        def split(members):
            best = None
            g_all, h_all = (sum(x[i] for x in members) for i in (1, 2))
            for test in tests:
                g = sum(x[1] for x in members if x[0][test[0]] == test[1])
                h = sum(x[2] for x in members if x[0][test[0]] == test[1])
                gain = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, test)
            return best[1]

        leaf = lambda members: rate * sum(x[1] for x in members) / (sum(x[2] for x in members) + ridge)
        for _ in range(rounds):
            rows = []
            for (x, y, n), s in zip(train, score, strict=True):
                p = 1 / (1 + math.exp(-s))
                rows.append((x, n * (y - p), n * p * (1 - p)))
            top = split(rows)
            sides = []
            for yes in (True, False):
                members = [r for r in rows if (r[0][top[0]] == top[1]) == yes]
                low = split(members) if members else top
                sides.append((low, leaf([r for r in members if r[0][low[0]] == low[1]]), leaf([r for r in members if r[0][low[0]] != low[1]])))
            self.trees.append((top, *sides))
            score = [s + self._tree(self.trees[-1], x) for (x, _, _), s in zip(train, score, strict=True)]

    @staticmethod
    def _tree(tree, x) -> float:
        top, yes, no = tree
        low, a, b = yes if x[top[0]] == top[1] else no
        return a if x[low[0]] == low[1] else b

    def score(self, x) -> float:
        return self.base + sum(self._tree(t, x) for t in self.trees)

    def expression(self, f: Column) -> Column:
        """The score as a column, from a struct of features."""
        names = list(FEATURES)
        test = lambda t: f[names[t[0]]] == t[1]
        total = F.lit(self.base)
        for top, (yt, ya, yb), (nt, na, nb) in self.trees:
            total = total + F.when(test(top), F.when(test(yt), ya).otherwise(yb)).otherwise(F.when(test(nt), na).otherwise(nb))
        return total


def thresholds(cells: list, precision: float) -> list[float]:
    """For each kind the lowest score from which on candidates of left-out folds are labelled often enough; infinite if none."""
    models = {k: Boosted(cells, without=k) for k in {c["fold"] for c in cells}}
    out = []
    for kind in range(len(ALL_KINDS)):
        at: dict[float, list[int]] = {}
        for c in cells:
            if c["f_kind"] == kind and models[c["fold"]].fitted:
                at.setdefault(models[c["fold"]].score(tuple(c[f"f_{f}"] for f in FEATURES)), [0, 0])[c["label"]] += c["count"]
        limit, good, n = math.inf, 0, 0
        for s in sorted(at, reverse=True):
            good, n = good + at[s][1], n + sum(at[s])
            if good >= precision * (n + 1):
                limit = s
        out.append(limit)
    return out


def with_spans(found: DataFrame, cells: list, precision: float = 0.9) -> DataFrame:
    """``found`` (of :func:`candidates`) with ``spans``: base spans and the candidates that the trees add, by start, then kind."""
    model = Boosted(cells)
    limits = thresholds(cells, precision) if model.fitted else [math.inf] * len(ALL_KINDS)
    base = F.col("base")
    if all(math.isinf(x) for x in limits):
        added = F.expr("cast(array() as array<struct<kind:int,s:int,e:int>>)")
    else:
        at_least = lambda c: F.coalesce(*[F.when(c["kind"] == k, F.lit(float(min(x, 1e9)))) for k, x in enumerate(limits)])
        scored = F.transform(F.filter("loose", lambda c: ~_overlaps(base, c["s"], c["e"])), lambda c: F.struct(model.expression(c["f"]).alias("score"), (c["e"] - c["s"]).alias("n"), (-c["s"]).alias("from"), (-c["kind"]).alias("of"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind")))
        found = found.withColumn("scored", scored).withColumn("scored", F.filter("scored", lambda c: c["score"] >= at_least(c)))
        best = F.filter("scored", lambda c: ~F.exists("scored", lambda o: (o["s"] < c["e"]) & (c["s"] < o["e"]) & (F.struct(o["score"], o["n"], o["from"], o["of"]) > F.struct(c["score"], c["n"], c["from"], c["of"]))))
        added = F.transform(best, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    order = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["kind"], x["e"]))), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return found.withColumns({"base": order(base), "spans": order(F.concat(base, added))})


def _kind(x: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in ALL_KINDS]), x["kind"] + 1)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _kind(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """row (a struct of the columns of ``docs``), text (null: empty), and arrays (kind, s, e) of base spans and of all spans."""
    found = keep(candidates(docs), "pii-candidates")
    return with_spans(found, cell_counts(found), precision).select("row", "text", "base", "spans")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first names it."""
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(_kind(x)), F.lit("]")))
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(text)


def redact(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """``docs`` with the spans in ``text`` redacted; null texts stay null."""
    text = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(redacted(F.col("text"), F.col("spans")))
    return find(docs, precision).select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def _of(code: int):
    return lambda x: x["kind"] == code


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents: counts and a hash of the base spans, all spans, those added, and the redacted text."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("row.doc_id", *counts, F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), added, redacted(F.col("text"), F.col("spans")).alias("text"))
