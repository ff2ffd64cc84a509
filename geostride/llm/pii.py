"""Personal data by candidate gradient boosting. DataFrame operations only on the path of the data.

High-recall generators propose spans, which may overlap: the strict forms (email, ip, card, phone) and looser ones
(spelled-out addresses, local phone numbers, card-like and address-like digit groups). Boosted trees score every
loose candidate from its format and the words around it; thresholds calibrated on held-out examples select. A strict
match that holds its own check (digit counts, Luhn, octets) is always selected.

The trees are fitted by gradient boosting in numpy on the driver, on TRAIN_ROWS labelled examples that this module
generates from a seed (no table holds labels of this kind); they are then compiled to nested CASE expressions, so the
data never leave the JVM. The examples stand in contexts of words that are features and of words that are not, before and
after the candidate, and in plain prose; README has the figures on contexts and forms that no example has.

Spans are in code points, end exclusive. A match's place is found by adding up the lengths of the pieces between the
matches, in two levels, so that a text with very many matches costs no square of them. All repetition is possessive, so
that no text, however long its runs of digits or dots, recurses or backtracks.

Defined cases: null text is empty; empty texts have no spans; repeated rows get equal results; columns of any name pass
through `redact`, and through `with_spans` all but those it adds (base_spans, spans).
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostride.session import table

KINDS = ("email", "ip", "card", "phone")
#: The strict forms. The look-behinds only skip places at which a match of the plain form could not begin.
STRICT = {
    "email": r"((?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)",
    "ip": r"((?<![0-9])[0-9]++(?:\.[0-9]++){3})",
    "card": r"([0-9](?:[ -]?[0-9])++)",
    "phone": r"(\+[0-9][ ().0-9-]+[0-9])",
}
#: Looser forms that only the trees decide, by the kind they count as.
LOOSE = {
    "email": r"((?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?(?:at|AT) ?[\])}] ?(?:[A-Za-z0-9-]{1,64}+(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?)){1,4}[A-Za-z]{2,12}+)",
    "phone": r"((?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]))",
    "card": r"((?<![0-9A-Za-z.])[0-9]{4}[. -][0-9]{4,6}[. -][0-9]{4,5}(?:[. -][0-9]{1,4})?(?![0-9A-Za-z]))",
    "ip": r"((?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:]))",
}
#: A text without this can't hold a match that counts; cheaper to look for than the match.
NEEDS = {"email": "[A-Za-z0-9]@[A-Za-z0-9-]|[._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
CONTEXT = 24
CUES = (
    "call", "tel", "phone", "fax", "mobile", "dial", "mail", "contact", "write", "card", "visa", "pay", "ip", "host", "server", "address",
    "order", "isbn", "version", "ref", "id", "invoice", "serial", "part", "item", "page", "no.", "#", "$",
)
#: What follows a number that counts or measures something, and one that has an extension.
UNIT_AFTER, EXTENSION_AFTER = r"^ ?(?:%|usd|eur|kg|km|pcs|units?|pages?|items?)", r"^,? ?(?:ext|x ?[0-9])"
DOMAIN_END = r"(?i)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl|ch|at)$"
FEATURES = ("kind", "length", "digits", "separators", "parens", "luhn", "distinct", "domain_end", "after_letter", "unit_after", "extension_after", "letter_follows", *(f"cue_{c}" for c in CUES))
TRAIN_ROWS, TREES, DEPTH, RATE = 4000, 32, 3, 0.3
#: Matches that are put together at once.
TOGETHER = 64
PRECISION = 0.96


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    weight = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.floor(weight(i) / 10).cast("int") + (weight(i) % 10).cast("int"))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(OCTETS)
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    return n.between(10, 15) if kind == "phone" else F.when(n.between(14, 19), luhn(digits)).otherwise(False)


def _spans(text: Column, kind: str, pattern: str, keep, context: bool = False) -> Column:
    """Array of (start, kind, end, text, before, after) of the pattern's matches that `keep` keeps, in order; the text
    around a match only if asked for."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    struct = "struct<start:int,kind:int,end:int,found:string,before:string,after:string>"
    empty = F.array().cast(f"array<{struct}>")
    pairs = F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("p"), *([F.slice(pieces, 2, F.size(matches)).alias("q")] if context else []))
    around = lambda x: (F.right(x["p"], F.lit(CONTEXT)), F.left(x["q"], F.lit(CONTEXT))) if context else (F.lit(""), F.lit(""))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        before, after = around(x)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["m"].alias("found"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("pos"), F.when(keep(x["m"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def stretch(acc: Column, xs: Column) -> Column:
        own = F.aggregate(xs, F.struct(acc["pos"].alias("pos"), empty.alias("spans")), step)
        return F.transform(F.array(own), lambda o: F.struct(o["pos"].alias("pos"), F.when(F.size(o["spans"]) > 0, F.concat(acc["lists"], F.array(o["spans"]))).otherwise(acc["lists"]).alias("lists")))[0]

    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(matches)), F.lit(TOGETHER))
    stretches = F.transform(F.array(pairs), lambda all_: F.transform(starts, lambda k: F.slice(all_, k, F.lit(TOGETHER))))[0]
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{struct}>>").alias("lists"))
    found = F.aggregate(stretches, zero, stretch, lambda acc: F.flatten(acc["lists"]))
    possible = text.rlike(NEEDS[kind] if pattern == STRICT[kind] else pattern)
    return F.when(possible, found).otherwise(empty)


def _features(span: Column) -> dict[str, Column]:
    """Of a candidate: its format and its context."""
    m, before, after = span["found"], F.lower(span["before"]), F.lower(span["after"])
    digits = F.regexp_replace(m, "[^0-9]", "")
    out = {
        "kind": span["kind"].cast("double"), "length": F.char_length(m).cast("double"), "digits": F.length(digits).cast("double"),
        "separators": F.length(F.regexp_replace(m, "[^ .:-]", "")).cast("double"), "parens": F.length(F.regexp_replace(m, r"[^()\[\]{}]", "")).cast("double"),
        "luhn": F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False).cast("double"),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))).cast("double"), "domain_end": m.rlike(DOMAIN_END).cast("double"), "after_letter": before.rlike("[a-z]$").cast("double"),
        "unit_after": after.rlike(UNIT_AFTER).cast("double"), "extension_after": after.rlike(EXTENSION_AFTER).cast("double"), "letter_follows": after.rlike("^[a-z]").cast("double"),
    }
    return out | {f"cue_{c}": F.contains(before, F.lit(c)).cast("double") for c in CUES}


def py_features(kind: int, m: str, before: str, after: str) -> list[float]:
    """The same features of an example."""
    d = "".join(c for c in m if c in "0123456789")
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
    low, follows = before.lower(), after.lower()
    return [
        kind, len(m), len(d), sum(c in " .:-" for c in m), sum(c in "()[]{}" for c in m), float(13 <= len(d) <= 19 and total % 10 == 0), len(set(d)) or 1, float(bool(re.search(DOMAIN_END, m))),
        float(low[-1:].isascii() and low[-1:].isalpha()), float(bool(re.search(UNIT_AFTER, follows))), float(bool(re.search(EXTENSION_AFTER, follows))), float(bool(re.search("^[a-z]", follows))),
        *(float(c in low) for c in CUES),
    ]


#: Words before personal candidates and look-alikes of the examples. Some are features and some are not.
PERSONAL_WORDS = (
    ("mail", "contact", "write to", "questions to", "ask", "from", "by", "reach"), ("ip", "host", "server", "login from", "seen at", "peer"),
    ("card", "visa", "pay with", "charged to", "billed"), ("call", "tel", "phone", "fax", "mobile", "dial", "ring", "text", "reach us on", "office"),
)
OTHER_WORDS = ("order", "ref", "isbn", "version", "id", "invoice", "serial", "part", "item", "page", "no.", "#", "$", "lot", "batch", "ticket", "model", "score", "row")
PROSE = ("the", "und", "le", "of", "and then", "que", "was seen", "in one", "ein", "de la", "it has", "for")


def example_form(r: random.Random, kind: int, personal: bool) -> str:
    """A candidate of the kind: a sound form, or a look-alike."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == 0:
        if not personal:
            return f"{r.choice(('see', 'f', 'row', 'item', 'g', 'up'))}{r.choice((' (at) ', '[at]', ' [at] ', '(at)'))}{r.choice(('x', 'n', 'point', 'page', 'idx'))}{digits(r.choice((0, 1, 2)))}.{r.choice(('left', 'right', 'py', 'max', 'size'))}"
        name = "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(3, 9))) + r.choice(("", "", ".doe", digits(2), "_x"))
        return f"{name}{r.choice(('[at]', ' [at] ', ' (at) ', '(at)', '{at}'))}{r.choice(('mail', 'example', 'post', 'my-web', 'inbox'))}{digits(r.choice((0, 0, 1)))}{r.choice(('', '', '.example'))}{r.choice(('.', '.', ' [dot] ', '(dot)'))}{r.choice(('com', 'org', 'de', 'net'))}"
    if kind == 1:
        return ":".join(f"{r.randrange(65536):x}" for _ in range(8)) if personal else ":".join(digits(2) for _ in range(r.choice((4, 5, 6))))
    if kind == 2:
        if not personal:
            return r.choice(". -").join(digits(4) for _ in range(4))
        body = r.choice("3456") + digits(14)
        body += str(-sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body))) % 10)
        return r.choice(".- ").join(body[k : k + 4] for k in (0, 4, 8, 12))
    return r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}") if personal else ("{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(digits(3), digits(3), digits(4))


def example_context(r: random.Random, personal: tuple[str, ...], other: tuple[str, ...], prose: tuple[str, ...], is_personal: bool) -> tuple[str, str]:
    """(before, after): prose, then often a word that goes with the label, then what may stand between."""
    words = [r.choice(prose) for _ in range(r.randint(0, 3))]
    if r.random() < 0.8:
        words.append(r.choice(personal if is_personal else other))
    before = " ".join(words) + r.choice((" ", " ", ": ", " (" if is_personal else " =", " - "))
    after = r.choice((" ", ". ", ", ", " " + r.choice(prose), ") "))
    if r.random() < 0.15:
        after = r.choice((" ext 12", " x4", ", or")) if is_personal else r.choice((" usd", " units", " pcs", " kg", "%", " pages"))
    return before[-CONTEXT:], after[:CONTEXT]


def labelled_examples(rows: int = TRAIN_ROWS, seed: int = 7, personal: tuple = PERSONAL_WORDS, other: tuple = OTHER_WORDS, prose: tuple = PROSE) -> tuple[np.ndarray, np.ndarray]:
    """Seeded examples of loose candidates: personal ones (by their context and a sound form) and look-alikes. One in a
    hundred has the wrong label."""
    r = random.Random(seed)
    x, y = [], []
    for _ in range(rows):
        kind, is_personal = r.choice((0, 1, 2, 3, 3)), r.random() < 0.5
        form = example_form(r, kind, is_personal)
        before, after = example_context(r, personal[kind], other, prose, is_personal)
        x.append(py_features(kind, form, before, after))
        y.append(is_personal if r.random() < 0.99 else not is_personal)
    return np.array(x, float), np.array(y, float)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: ('leaf', value) or (feature, cut, left, right)."""
    best = (1e-6, None, None)
    if depth:
        parent = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2 if len(values) <= 33 else np.quantile(x[:, f], np.linspace(0.05, 0.95, 19)):
                left = x[:, f] <= cut
                hl = h[left].sum()
                gain = g[left].sum() ** 2 / (hl + 1) + g[~left].sum() ** 2 / (h.sum() - hl + 1) - parent
                if gain > best[0]:
                    best = (gain, f, float(cut))
    if best[1] is None:
        return ("leaf", float(RATE * g.sum() / (h.sum() + 1)))
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    return np.where(x[:, tree[0]] <= tree[1], _apply(tree[2], x), _apply(tree[3], x))


@lru_cache(maxsize=1)
def fitted() -> tuple[tuple, tuple[float, ...]]:
    """(trees, threshold of the raw score for each kind): boosted on two thirds of the examples, calibrated on the rest
    to the lowest score at which the selected share is right with PRECISION."""
    x, y = labelled_examples()
    held = np.arange(len(x)) % 3 == 0
    score, trees = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x[~held], (y - p)[~held], (p * (1 - p))[~held], DEPTH))
        score += _apply(trees[-1], x)
    cuts = []
    for k in range(len(KINDS)):
        own = held & (x[:, 0] == k)
        s, t = score[own], y[own]
        order = np.argsort(-s, kind="stable")
        precision = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        fine = np.flatnonzero(precision >= min(PRECISION, precision[: max(1, len(t) // 5)].max()))
        cuts.append(max(0.0, float(s[order][fine[-1]])) if len(fine) else float("inf"))
    return tuple(trees), tuple(cuts)


def _tree_expr(tree, features: list[Column]) -> Column:
    if tree[0] == "leaf":
        return F.lit(tree[1])
    return F.when(features[tree[0]] <= tree[1], _tree_expr(tree[2], features)).otherwise(_tree_expr(tree[3], features))


def _scored(candidates: Column) -> Column:
    """Candidates with raw score, those at or over their kind's threshold."""
    trees, cuts = fitted()
    featured = F.transform(candidates, lambda c: F.struct(c.alias("span"), F.struct(*(v.alias(k) for k, v in _features(c).items())).alias("x")))

    def score(c: Column) -> Column:
        columns = [c["x"][k] for k in FEATURES]
        total = F.lit(0.0)
        for tree in trees:
            total = total + _tree_expr(tree, columns)
        return F.struct(total.alias("score"), *(c["span"][k].alias(k) for k in ("start", "kind", "end")))

    limit = F.array(*(F.lit(c) for c in cuts))
    return F.filter(F.transform(featured, score), lambda c: c["score"] >= F.element_at(limit, c["kind"] + 1))


def _own(docs: DataFrame, text: str) -> DataFrame:
    """(_row: the row's own columns, whose names then meet none of this operator's; _whole: the text, null as empty)."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_whole"))


def _found(rows: DataFrame) -> DataFrame:
    """Adds base_spans and spans to _row and _whole."""
    plain = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    for kind in KINDS:
        rows = rows.withColumn(f"_{kind}", _spans(F.col("_whole"), kind, STRICT[kind], lambda m, kind=kind: _valid(kind, m)))
    rows = rows.withColumn("base_spans", F.array_sort(plain(F.concat(*(F.col(f"_{k}") for k in KINDS)))))
    always = lambda m: F.lit(True)
    rows = rows.withColumn("_loose", F.concat(*(_spans(F.col("_whole"), k, LOOSE[k], always, context=True) for k in KINDS)))
    # nothing below runs for a text without loose candidates
    empty = F.array().cast("array<struct<score:double,start:int,kind:int,end:int>>")
    rows = rows.withColumn("_scored", F.when(F.size("_loose") > 0, _scored(F.col("_loose"))).otherwise(empty))
    chosen = F.when(F.size("_scored") > 0, _apart(F.col("base_spans"), F.col("_scored"))).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return rows.withColumn("spans", F.array_sort(F.concat("base_spans", chosen))).select("_row", "_whole", "base_spans", "spans")


def _apart(base: Column, scored: Column) -> Column:
    """Of the scored candidates those that overlap no base span and no better candidate that overlaps none. All spans are
    walked once in the order of their starts; only runs that overlap are compared with each other."""
    item = "struct<start:int,end:int,is_base:boolean,score:double,kind:int>"
    as_item = lambda s, is_base: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(is_base).alias("is_base"), (F.lit(0.0) if is_base else s["score"]).alias("score"), s["kind"].alias("kind"))
    ordered = F.array_sort(F.concat(F.transform(base, lambda s: as_item(s, True)), F.transform(scored, lambda s: as_item(s, False))))
    none = F.array().cast(f"array<{item}>")

    def walk(acc: Column, s: Column) -> Column:
        begins = s["start"] >= acc["end"]
        done = F.when(begins & (F.size(acc["run"]) > 0), F.concat(acc["runs"], F.array(acc["run"]))).otherwise(acc["runs"])
        return F.struct(F.when(begins, F.array(s)).otherwise(F.concat(acc["run"], F.array(s))).alias("run"), done.alias("runs"), F.when(begins, s["end"]).otherwise(F.greatest(acc["end"], s["end"])).alias("end"))

    zero = F.struct(none.alias("run"), F.array().cast(f"array<array<{item}>>").alias("runs"), F.lit(0).alias("end"))
    runs = F.aggregate(ordered, zero, walk, lambda acc: F.concat(acc["runs"], F.array(acc["run"])))
    over = lambda a, b: (a["end"] > b["start"]) & (b["end"] > a["start"])
    key = lambda c: F.struct(c["score"], -c["start"], -c["kind"], c["end"])

    def best(run: Column) -> Column:
        free = F.filter(run, lambda c: ~c["is_base"] & ~F.exists(run, lambda b: b["is_base"] & over(b, c)))
        return F.transform(F.array(free), lambda f: F.filter(f, lambda c: ~F.exists(f, lambda o: over(c, o) & (key(o) > key(c)))))[0]

    return F.transform(F.flatten(F.transform(runs, best)), lambda c: F.struct(c["start"], c["kind"], c["end"]))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_spans and spans: arrays of (start, kind, end), kind an index in KINDS, by start, then kind."""
    kept = (f"_row.`{c}`" for c in docs.columns if c not in ("base_spans", "spans"))
    return _found(_own(docs, text)).select(*kept, "base_spans", "spans")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


#: Code points of a piece of a text that is cut up for redaction.
PIECE = 4096


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans are replaced as one, by the
    first one's kind. Null texts stay null, clean texts stay as they are."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        # only the pieces that hold the stretch are looked at, not the text from its start
        first = F.floor(a / PIECE).cast("int")
        count = F.floor((b + PIECE - 1) / PIECE).cast("int") - first
        return F.when(b <= a, "").otherwise(F.substring(F.array_join(F.slice(pieces, first + 1, F.greatest(F.lit(0), count)), ""), a - first * PIECE + 1, b - a))

    def step(pieces: Column):
        def cut(acc: Column, s: Column) -> Column:
            parts = F.concat(acc["parts"], F.array(between(pieces, acc["pos"], s["start"]), F.element_at(names, s["kind"] + 1)))
            return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] < acc["pos"], acc["parts"]).otherwise(parts).alias("parts"))

        return cut

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts"))
    n = F.char_length("_whole")
    finish = lambda pieces: lambda acc: F.concat(F.array_join(acc["parts"], ""), between(pieces, acc["pos"], n))
    pieces = F.regexp_extract_all("_whole", F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))
    done = F.transform(F.array(pieces), lambda p: F.aggregate("spans", zero, step(p), finish(p)))[0]
    rows = _found(_own(docs, text))
    kept = F.col(f"_row.`{text}`")
    return rows.select(*((F.when(F.size("spans") > 0, done).otherwise(kept) if c == text else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    rows = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
