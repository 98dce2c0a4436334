"""Personal data by boosted candidates, with DataFrame functions only.

Per text, four base rules find e-mail and IP addresses, card and phone numbers. Two generous generators
propose further spans (they may overlap the base ones): anything laid out like an address, anything laid
out like a long number. Boosted trees score a proposal by its format and context; they are
fitted on which proposals the base rules confirm, without being shown what those rules check (the leading
plus, the check digit, how an @ or a dot is written). All proposals of the corpus count: features are few and binned, so
the training set is a table of counts, bounded by the bins. A threshold calibrated on another half of
the documents (isotonically: proposals of that very score must be right often enough) selects what is added. Everything on the executors is built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.shared import column, materialize, whole_row

KINDS = ("email", "ip", "card", "phone")
# A match can only begin where a run of its first characters does, or where the last match ended: from
# elsewhere in the run it would fail or succeed alike. So that runs aren't scanned again from each of their places.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "address": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)*+",
    "number": r"(?:\G|(?<![0-9(+.-]))[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
FEATURES = {"digits": 12, "marks": 6, "dots": 5, "parens": 2, "before": 5, "after": 5, "tail": 6, "address": 2}
PRECISION = 0.95
ROUNDS = 30
_BLOCK = 256


def _hint(text: Column, name: str) -> Column:
    """A cheap test that texts without any match mostly fail."""
    if name == "email":
        return text.contains("@")
    if name == "phone":
        return text.contains("+")
    if name == "address":
        return text.contains("@") | text.contains("(at)") | text.contains("[at]")
    return text.rlike(r"[0-9]\.[0-9]" if name == "ip" else r"[0-9][\x20().-]{0,2}[0-9]")


def _prefix(lengths: Column, k: Column) -> Column:
    """Sum of the first k lengths, by sums of blocks, so that thousands of matches stay cheap."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    return add(F.slice(lengths, F.floor(k / _BLOCK).cast("int") * _BLOCK + 1, (k % _BLOCK).cast("int")))


def _found(docs: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Adds column ``name``: array of (start, stop, match), in code points, of all matches from the left."""
    t, none = F.col(text), F.array().cast("array<string>")
    hint = _hint(t, name)
    step = docs.withColumn("__m", F.when(hint, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
    step = step.withColumn("__l", F.when(F.size("__m") > 0, F.transform(F.split(t, pattern, -1), lambda p: F.length(p))).otherwise(F.array().cast("array<int>")))
    step = step.withColumn("__l", F.zip_with("__l", F.transform("__m", lambda m: F.length(m)), lambda gap, m: gap + F.coalesce(m, F.lit(0))))
    step = step.withColumn("__b", F.transform(F.sequence(F.lit(0), F.floor(F.size("__l") / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice("__l", b * _BLOCK + 1, _BLOCK), F.lit(0), lambda s, x: s + x)))
    # a gap and its match make one step: a match ends where the steps up to it do
    stop = lambda i: F.aggregate(F.slice("__b", F.lit(1), F.floor((i + 1) / _BLOCK).cast("int")), F.lit(0), lambda s, x: s + x) + _prefix(F.col("__l"), i + 1)
    spans = F.transform("__m", lambda m, i: F.struct((stop(i) - F.length(m)).alias("start"), stop(i).alias("stop"), m.alias("match")))
    # naming the helper columns again outside the function keeps the optimizer from moving their making into it, where it would run for each match
    return step.withColumn(name, F.when((F.size("__l") > 0) & (F.size("__b") > 0), spans).otherwise(F.slice(spans, 1, 0))).drop("__m", "__l", "__b")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def worth(i):
        d = F.ascii(F.substring(backwards, i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


_VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: s["match"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda s: F.when(F.length(_digits(s["match"])).between(13, 19), _luhn(_digits(s["match"]))).otherwise(False),
    "phone": lambda s: F.length(_digits(s["match"])).between(9, 15),
}


def _features(text: Column, s: Column) -> Column:
    """Bins of one proposal; none of them shows the plus, the check digit or how an @ or a dot is written."""
    m = s["match"]
    n = F.length(_digits(m))
    digits = F.when(n <= 4, 0).when(n <= 6, 1).when(n <= 8, 2).when(n <= 12, n - 6).when(n <= 15, 7).when(n == 16, 8).when(n <= 19, 9).otherwise(10)
    address = m.rlike(r"[A-Za-z]").cast("int")
    marks = F.when(address == 1, 0).otherwise(F.least(F.lit(5), F.length(F.regexp_replace(m, r"[^\x20-]", ""))))
    dots = F.least(F.lit(4), F.length(F.regexp_replace(F.regexp_replace(m, r"^.*(?:@|\(at\)|\[at\])|\(dot\)|\[dot\]", "."), r"[^.]", "")))

    def side(c):
        return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^\p{L}$"), 2).when(c.rlike(r"^[0-9]$"), 3).otherwise(4)

    before = F.when(s["start"] == 0, F.lit("")).otherwise(F.substring(text, s["start"], F.lit(1)))
    after = F.substring(text, s["stop"] + 1, F.lit(1))
    tail = F.least(F.lit(5), F.length(F.regexp_extract(m, r"([A-Za-z0-9]+)$", 1)))
    columns = {"digits": digits, "marks": marks, "dots": dots, "parens": F.when(address == 1, 0).otherwise(m.contains("(").cast("int")), "before": side(before), "after": side(after), "tail": tail, "address": address}
    return F.struct(*[columns[f].cast("int").alias(f) for f in FEATURES])


def proposals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column per base kind (its valid spans), ``half`` and ``more``: proposals with features and ``sure``, whether a base span is the same."""
    text = "__text"
    out = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    for kind in KINDS:
        out = _found(out, text, kind, PATTERNS[kind])
        out = out.withColumn(kind, F.filter(kind, _VALID[kind]))
    for name, pattern in GENERATORS.items():
        out = _found(out, text, name, pattern)
    base = F.concat(*[F.transform(k, lambda s: F.struct(s["start"], s["stop"])) for k in KINDS])

    def described(s):
        number = F.length(_digits(s["match"]))
        kind = F.when(s["match"].rlike("[A-Za-z]"), 0).when(s["match"].rlike(r"^[0-9]+(\.[0-9]+){3}$"), 1).when(number >= 13, 2).otherwise(3)
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), kind.alias("kind"), _features(F.col(text), s).alias("f"))

    enough = F.concat("address", F.filter("number", lambda s: F.length(_digits(s["match"])) >= 7))
    out = out.withColumn("more", F.transform(enough, described)).withColumn("__base", base)
    out = out.withColumn("half", F.pmod(F.xxhash64(text), F.lit(2)).cast("int"))
    return out.withColumn("more", F.transform("more", lambda s: s.withField("sure", F.exists("__base", lambda b: (b["start"] == s["start"]) & (b["stop"] == s["stop"]))).withField("clear", ~F.exists("__base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))))).drop(text, "__base", *GENERATORS)


@dataclass
class Model:
    trees: list  # (feature, cut, (feature, cut) or None of either side, four values)
    threshold: float


def _boost(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int = ROUNDS, rate: float = 0.4) -> list:
    """Newton-boosted trees of depth two on weighted rows of bins; deterministic."""
    z, trees = np.zeros(len(x)), []

    def best(rows, g, h):
        top = (1e-6, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1].tolist():
                left = rows & (x[:, f] <= cut)
                right = rows & ~left
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - whole
                if gain > top[0]:
                    top = (gain, (f, cut))
        return top[1]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = pos - (pos + neg) * p, (pos + neg) * p * (1 - p)
        root = best(np.ones(len(x), bool), g, h)
        if root is None:
            break
        left = x[:, root[0]] <= root[1]
        sides, values = [], []
        for rows in (left, ~left):
            split = best(rows, g, h)
            sides.append(split)
            parts = (rows & (x[:, split[0]] <= split[1]), rows & (x[:, split[0]] > split[1])) if split else (rows, rows)
            for part in parts:
                values.append(float(rate * g[part].sum() / (h[part].sum() + 1)))
                if split or part is parts[0]:
                    z[part] += values[-1]
        trees.append((root, sides[0], sides[1], values))
    return trees


def _margin_of(trees: list, x: np.ndarray) -> np.ndarray:
    z = np.zeros(len(x))
    for root, a, b, v in trees:
        left = x[:, root[0]] <= root[1]
        for rows, split, lo, hi in ((left, a, v[0], v[1]), (~left, b, v[2], v[3])):
            z += np.where(rows, np.where(x[:, split[0]] <= split[1], lo, hi) if split else lo, 0)
    return z


def _margin(trees: list, f: Column) -> Column:
    names, total = list(FEATURES), F.lit(0.0)
    for root, a, b, v in trees:
        side = lambda split, lo, hi: F.when(f[names[split[0]]] <= split[1], F.lit(lo)).otherwise(F.lit(hi)) if split else F.lit(lo)
        total = total + F.when(f[names[root[0]]] <= root[1], side(a, v[0], v[1])).otherwise(side(b, v[2], v[3]))
    return total


def learn(proposed: DataFrame, precision: float = PRECISION) -> Model:
    """Fits on one half of the documents (by a hash of the text), calibrates on the other.

    Without proposals, or if no threshold reaches ``precision``, nothing is ever added.
    """
    each = proposed.where(F.size("more") > 0).select("half", F.explode("more").alias("s")).select("half", "s.f.*", F.col("s.sure").cast("int").alias("sure"))
    rows = each.groupBy("half", *FEATURES).agg(F.sum("sure").alias("pos"), F.count("*").alias("n")).collect()  # as many rows as there are bins at most
    never = Model([], float("inf"))
    if not rows:
        return never
    part = np.array([r["half"] for r in rows])
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    pos, n = np.array([r["pos"] for r in rows], float), np.array([r["n"] for r in rows], float)
    order = np.lexsort(x.T)
    part, x, pos, n = part[order], x[order], pos[order], n[order]
    a, b = part == 0, part == 1
    if not a.any() or not b.any():
        return never
    trees = _boost(x[a], pos[a], (n - pos)[a])
    z = _margin_of(trees, x[b])
    blocks: list[list[float]] = []  # positives, all, lowest score; shares that never rise with a falling score
    for level in sorted(set(z.tolist()), reverse=True):
        at = z == level
        blocks.append([pos[b][at].sum(), n[b][at].sum(), level])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] < blocks[-1][0] * blocks[-2][1]:
            p, c, low = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + c, low]
    good = [low for p, c, low in blocks if p >= precision * c]
    return Model(trees, min(good) - 1e-9) if good else never


def _labelled(kind: Column, s: Column) -> Column:
    return F.struct(kind.cast("int").alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))


def select_spans(proposed: DataFrame, model: Model) -> DataFrame:
    """Replaces the columns of ``proposals`` by ``base`` and ``spans``: arrays of (kind, start, stop), in this order."""
    of_kind = lambda i: lambda s: _labelled(F.lit(i), s)
    base = F.concat(*[F.transform(k, of_kind(i)) for i, k in enumerate(KINDS)])
    out = proposed.withColumn("base", base)
    if model.trees and model.threshold < float("inf"):
        added = F.transform(F.filter("more", lambda s: s["clear"] & (_margin(model.trees, s["f"]) >= model.threshold)), lambda s: _labelled(s["kind"], s))
        out = out.withColumn("spans", F.array_sort(F.array_union("base", added)))
    else:
        out = out.withColumn("spans", F.col("base"))
    return out.withColumns({f"n_{k}": F.size(k).cast("long") for k in KINDS}).drop("more", "half", *KINDS)


def _joined(spans: str) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row; a null text is empty.

    Repeated rows have equal results, null ids stay null, texts are searched whole; a text without spans has zeros, an empty list and the
    empty string's digest. Of equal starts the kind listed first comes first. An empty table gives no rows. Other columns aren't looked at.
    """
    slim = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    proposed = materialize(proposals(slim).drop("text"), "proposals")
    found = select_spans(proposed, learn(proposed))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets, overlapping ones, as one, by the first's. Null texts stay null."""
    names = docs.columns
    proposed = materialize(proposals(docs.select(whole_row(docs).alias("__row"), column(text_col).alias("text"))).drop("text"), "proposals")
    found = select_spans(proposed, learn(proposed)).withColumn("text", F.coalesce(F.col("__row").getField(text_col), F.lit("")))
    by_place = F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["stop"] > b["stop"], -1).when(a["stop"] < b["stop"], 1).otherwise(0))
    tag = lambda s: F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(">"))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc, s):
        gap = F.substring("text", acc["at"] + 1, s["start"] - acc["at"])
        reach = F.struct(acc["done"].alias("done"), s["stop"].alias("at"))  # what an overlapping span adds goes too, under the first one's tag
        return F.when(s["stop"] <= acc["at"], acc).when(s["start"] < acc["at"], reach).otherwise(F.struct(F.concat(acc["done"], gap, tag(s)).alias("done"), s["stop"].alias("at")))

    whole = F.aggregate("sorted", start, step, lambda acc: F.concat(acc["done"], F.substring("text", acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("sorted") > 0, whole).otherwise(F.col("__row").getField(text_col)).alias(text_col)
    return found.withColumn("sorted", by_place).select(*[text if n == text_col else F.col("__row").getField(n).alias(n) for n in names])
