"""Personal data: high-recall candidates, boosted trees over format and context, calibrated thresholds.

* Base patterns with validators give the spans that are always reported.
* Three wide generators propose overlapping spans: anything like a number with separators, numbers in
  the groups of national number plans, and anything like a mail address, also a disguised one.
* Each candidate has small integer features of its format and its context. The base patterns' own marks
  (+ and @) are not among them, so that what is learned from base spans holds for spans without the mark.
* Examples are labelled weakly. Personal: overlaps a valid base span, stands after a contact word (tel,
  call, mail), or spells out at and dot. Not personal: a base match that its validator refused, a date,
  a price, what stands after version, build, page and the like. All others have no label and count as
  negatives with the weight UNLABELLED, so that a format for which nothing speaks scores low.
* An example with a telling word before it counts half as it is and half with the word hidden: what the
  words teach about a format holds where the words are missing.
* All candidates of the corpus are counted per combination of features and label; the table of counts has
  at most the product of the features' sizes rows however large the corpus is, and boosting on it equals
  boosting on every candidate.
* Trees of depth two are fitted to the logistic loss on one half of the ids, thresholds are calibrated
  on the other half: the lowest score, per generator, whose labelled candidates above are personal often
  enough. A candidate above the threshold that overlaps no base span is added; a plain number gives way
  to one in national groups.
The trees are applied as one SQL expression; no Python runs on the executors.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnscore.llm.common import staged
from dawnscore.llm.spans import with_matches

# The base patterns. \G and the look-behind let a match begin where the last one ended or
# at the head of a run; elsewhere inside a run no match can begin if none began at its head.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))(?=(?:[0-9][\x20-]?){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")
_AT = r"(?:@|\x20?[(\[{]\x20?(?i:at)\x20?[)\]}]\x20?|\x20(?i:at)\x20)"
_DOT = r"(?:\.|\x20?[(\[{]\x20?(?i:dot)\x20?[)\]}]\x20?|\x20(?i:dot)\x20)"
GENERATORS = {
    "number": r"(?<![0-9])[0-9][0-9 ().-]{5,40}[0-9](?![0-9])",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+" + _AT + "[A-Za-z0-9-]{1,63}+(?:" + _DOT + "[A-Za-z0-9-]{1,63}+){1,5}+",
    "national": (r"(?<![0-9])(?:1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
                 r"|(?<![0-9.,])0[1-9][0-9]{1,4}[ /-][0-9]{2,4}(?:[ -]?[0-9]{2,5}){1,3}(?![0-9])"),
}
KINDS = (*BASE_KINDS, *GENERATORS)
CONTEXT = 24
# Words before a candidate that speak for and against personal data.
_CONTACT = "tel|telefon|phone|call|mobile|fax|sms|whatsapp|contact|mail|email|e-mail|write|reach"
_OTHER = "version|build|release|date|isbn|issn|doi|page|section|chapter|price|total|cost|order|invoice|serial"
_DATE = ("^((19|20)[0-9]{2}[-. ](0?[1-9]|1[0-2])[-. ][0-3]?[0-9]|[0-3]?[0-9][-. ][0-3]?[0-9][-. ](19|20)?[0-9]{2})"
         "([^0-9].*)?$")
_AMOUNT = "^([0-9]{1,3}([ .][0-9]{3})+|[0-9]+[.][0-9]{1,2})$"
_PLAN = "[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-][0-9]{4}$"

_DIGITS = "char_length(regexp_replace(x.match, '[^0-9]', ''))"
_SEPARATORS = "char_length(regexp_replace(x.match, '[^ ().-]', ''))"


def _side(of: str) -> str:
    # a plus or a bracket is read as nothing: both belong to the format
    return (f"CASE WHEN {of} IN ('', '+', '(', ')') OR {of} rlike '[\\\\x20\\\\x09-\\\\x0D]' THEN 0 WHEN {of} rlike '\\\\p{{L}}' THEN 1 "
            f"WHEN {of} rlike '[0-9]' THEN 2 ELSE 3 END")


def _after(words: str) -> str:
    return f"lower(x.before) rlike '(^|[^a-z])({words})([^a-z]|$)'"


# name → (number of values, SQL over a candidate x)
FEATURES: dict[str, tuple[int, str]] = {
    "gen": (3, "CASE x.kind WHEN 'mail' THEN 1 WHEN 'national' THEN 2 ELSE 0 END"),
    "digits": (8, f"CASE WHEN {_DIGITS} = 0 THEN 0 WHEN {_DIGITS} < 7 THEN 1 WHEN {_DIGITS} < 9 THEN 2 "
                  f"WHEN {_DIGITS} < 12 THEN 3 WHEN {_DIGITS} < 13 THEN 4 WHEN {_DIGITS} < 17 THEN 5 "
                  f"WHEN {_DIGITS} < 20 THEN 6 ELSE 7 END"),
    "separators": (4, f"CASE WHEN {_SEPARATORS} = 0 THEN 0 WHEN {_SEPARATORS} < 3 THEN 1 WHEN {_SEPARATORS} < 5 THEN 2 ELSE 3 END"),
    "dots": (3, "CASE WHEN NOT contains(x.match, '.') THEN 0 "
                "WHEN char_length(regexp_replace(x.match, '[^.]', '')) = 3 THEN 1 ELSE 2 END"),
    "brackets": (2, "IF(x.match rlike '[(){}]' OR contains(x.match, '['), 1, 0)"),
    "shape": (4, f"CASE WHEN x.kind = 'mail' THEN 0 WHEN x.match rlike '{_PLAN}' THEN 1 WHEN x.match rlike '{_DATE}' THEN 2 "
                 f"WHEN x.match rlike '{_AMOUNT}' THEN 3 ELSE 0 END"),
    "suffix": (3, "CASE WHEN x.kind <> 'mail' THEN 0 WHEN x.match rlike '[^A-Za-z][A-Za-z]{2,6}$' THEN 1 ELSE 2 END"),
    "previous": (4, _side("right(x.before, 1)")),
    "next": (4, _side("left(x.after, 1)")),
    "words": (3, f"CASE WHEN {_after(_OTHER)} OR rtrim(x.before) rlike '[$€£]$' OR ltrim(x.after) rlike '^[$€£]' THEN 2 "
                 f"WHEN {_after(_CONTACT)} THEN 1 ELSE 0 END"),
}
# a mail address with at and dot spelled out, in brackets or both as words, and an end of letters
_SPELLED = ("x.kind = 'mail' AND x.match rlike '(?i)([(][ ]?at[ ]?[)]|\\\\x5B ?at ?\\\\x5D|[{][ ]?at[ ]?[}]|[ ]at[ ].*[^a-z]dot(?=[^a-z])).*"
            "[^a-z][a-z]{2,6}$'")
NAMES = tuple(FEATURES)
ROUNDS, RATE = 40, 0.3
PRECISION = 0.95        # lower bound; the labels themselves are weak
UNLABELLED = 0.1        # weight of a candidate without a label
POSITIVE, NEGATIVE, NONE = 1, 0, 2


def luhn(digits: str) -> str:
    """SQL: the digits of the expression pass the Luhn check."""
    return (f"(aggregate(transform(sequence(1, char_length({digits})), i -> cast(substring({digits}, -i, 1) as int) "
            "* IF(i % 2 = 0, 2, 1)), 0, (s, v) -> s + IF(v > 9, v - 9, v)) % 10 = 0)")


def _valid(kind: str) -> str:
    digits = "regexp_replace(x.match, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        return ("forall(split(x.match, '[.]'), p -> char_length(ltrim('0', p)) <= 3 "
                "AND coalesce(cast(nullif(ltrim('0', p), '') as int), 0) <= 255)")
    if kind == "card":
        return f"CASE WHEN char_length({digits}) BETWEEN 13 AND 19 THEN {luhn(digits)} ELSE false END"
    return f"char_length({digits}) BETWEEN 9 AND 15"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text → row_no, doc_id, base (kind, start, end), wide (kind, start, end, label, features)."""
    patterns = {"_m_email": (EMAIL, 0), "_m_ip": (IP, 0), "_m_card": (CARD, 0), "_m_phone": (PHONE, 0),
                **{f"_m_{k}": (p, 0) for k, p in GENERATORS.items()}}
    found = with_matches(docs, patterns, context=CONTEXT)
    tested = ", ".join(f"transform(_m_{k}, x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.end, 'valid', {_valid(k)}))"
                       for k in BASE_KINDS)
    wide = ", ".join(f"transform(_m_{k}, x -> named_struct('kind', '{k}', 'start', x.start, 'end', x.end, "
                     "'match', x.match, 'before', x.before, 'after', x.after))" for k in GENERATORS)
    spans = found.select("doc_id", F.expr(f"concat({tested})").alias("tested"), F.expr(f"concat({wide})").alias("wide"))
    kept = "transform(filter(tested, x -> {}), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))"
    spans = spans.select("doc_id", F.expr(kept.format("x.valid")).alias("base"),
                         F.expr(kept.format("NOT x.valid")).alias("refused"), "wide")
    values = ", ".join(f"'{n}', {sql}" for n, (_, sql) in FEATURES.items())
    overlaps = "exists({}, b -> b.start < x.end AND x.start < b.end)"
    spans = spans.select("doc_id", "base", F.expr(
        "transform(wide, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'label', "
        f"{overlaps.format('base')}, 'refused', {overlaps.format('refused')}, 'spelled', {_SPELLED}, {values}))").alias("wide"))
    weak = (f"CASE WHEN x.label THEN {POSITIVE} WHEN x.refused OR x.words = 2 OR x.shape IN (2, 3) THEN {NEGATIVE} "
            f"WHEN x.words = 1 OR x.spelled THEN {POSITIVE} ELSE {NONE} END")
    names = ", ".join(f"'{n}', x.{n}" for n in ("kind", "start", "end", "label", *NAMES))
    return spans.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "base", F.expr(
        f"transform(wide, x -> named_struct({names}, 'weak', {weak}))").alias("wide"))


@dataclass(frozen=True)
class Tree:
    """Two levels of tests `feature = value`: the root's, then one on either side; four leaf values."""
    root: tuple[int, int]
    yes: tuple[int, int]
    no: tuple[int, int]
    leaves: tuple[float, float, float, float]


@dataclass(frozen=True)
class Model:
    bias: float
    trees: tuple[Tree, ...]
    thresholds: dict[str, float]    # generator → least score; absent: nothing is added

    def sql(self) -> str:
        """Score of a candidate x."""
        def test(t: tuple[int, int]) -> str:
            return f"x.{NAMES[t[0]]} = {t[1]}"
        terms = [f"IF({test(t.root)}, IF({test(t.yes)}, {t.leaves[0]!r}D, {t.leaves[1]!r}D), "
                 f"IF({test(t.no)}, {t.leaves[2]!r}D, {t.leaves[3]!r}D))" for t in self.trees]
        return " + ".join([f"{self.bias!r}D", *terms])


def _split(gradient: np.ndarray, hessian: np.ndarray, tests: np.ndarray, rows: np.ndarray) -> int:
    """Number of the test with the largest gain on the rows."""
    g, h, t = gradient[rows], hessian[rows], tests[rows]
    left_g, left_h = g @ t, h @ t
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    return int(np.argmax(left_g ** 2 / (left_h + 1) + right_g ** 2 / (right_h + 1)))


def boost(combos: np.ndarray, count: np.ndarray, positive: np.ndarray) -> tuple[float, list[Tree], np.ndarray]:
    """Bias, trees and scores for weighted combinations of feature values (rows)."""
    listed = [(f, v) for f, name in enumerate(NAMES) for v in range(FEATURES[name][0])]
    tests = np.stack([(combos[:, f] == v).astype(float) for f, v in listed], 1)
    total, valid = count.sum(), positive.sum()
    bias = math.log((valid + 1) / (total - valid + 1))
    score = np.full(len(combos), bias)
    trees = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = positive - count * p, count * p * (1 - p)
        root = _split(gradient, hessian, tests, np.ones(len(combos), bool))
        on = tests[:, root] > 0
        sides, leaves, step = [], [], np.zeros(len(combos))
        for rows in (on, ~on):
            inner = _split(gradient, hessian, tests, rows)
            sides.append(listed[inner])
            for part in (rows & (tests[:, inner] > 0), rows & (tests[:, inner] == 0)):
                value = round(RATE * float(gradient[part].sum() / (hessian[part].sum() + 1)), 6)
                leaves.append(value)
                step[part] = value
        score = score + step
        trees.append(Tree(listed[root], sides[0], sides[1], tuple(leaves)))
    return bias, trees, score


def fit(found: DataFrame) -> Model:
    """Model from the counts of all candidates per combination of features, half of the ids and label."""
    rows = (found.select((F.pmod(F.xxhash64("doc_id"), F.lit(2))).alias("half"), F.explode("wide").alias("x"))
            .groupBy("half", *(F.col(f"x.{n}").alias(n) for n in (*NAMES, "weak"))).agg(F.count("*").alias("n"))
            .orderBy("half", *NAMES, "weak").collect())    # bounded by the features' sizes
    if not rows:
        return Model(0.0, (), {})
    half = np.array([r.half for r in rows])
    combos = np.array([[r[n] for n in NAMES] for r in rows])
    weak, number = np.array([r.weak for r in rows]), np.array([r.n for r in rows], float)
    # labelled examples with a telling word count half with it and half without
    words = NAMES.index("words")
    told = (weak != NONE) & (combos[:, words] != 0)
    number[told] /= 2
    hidden = combos[told].copy()
    hidden[:, words] = 0
    half, combos = np.append(half, half[told]), np.concatenate([combos, hidden])
    weak, number = np.append(weak, weak[told]), np.append(number, number[told])
    labelled = np.where(weak == NONE, 0.0, number)
    valid = np.where(weak == POSITIVE, number, 0.0)
    count = np.where(weak == NONE, UNLABELLED * number, number)
    fitted = half == 0 if (half == 0).any() else half == 1
    bias, trees, _ = boost(combos[fitted], count[fitted], valid[fitted])
    score = np.full(len(combos), bias)
    for t in trees:
        root, yes, no = (combos[:, f] == v for f, v in (t.root, t.yes, t.no))
        score += np.where(root, np.where(yes, t.leaves[0], t.leaves[1]), np.where(no, t.leaves[2], t.leaves[3]))
    held = half == 1 if (half == 1).any() else half == 0
    thresholds = {}
    for k, name in enumerate(GENERATORS):
        of = held & (combos[:, 0] == k) & (labelled > 0)
        order = np.argsort(-score[of], kind="stable")
        s, n, v = score[of][order], np.cumsum(labelled[of][order]), np.cumsum(valid[of][order])
        last = np.append(s[1:] < s[:-1], True) if len(s) else np.zeros(0, bool)     # equal scores go together
        # Wilson lower bound, so that few examples do not lower the threshold
        rate = v / np.maximum(n, 1)
        bound = (rate + 1.92 / n - 1.96 * np.sqrt((rate * (1 - rate) + 0.96 / n) / n)) / (1 + 3.84 / n)
        good = np.flatnonzero(last & (bound >= PRECISION))
        if len(good):
            thresholds[name] = round(float(s[good[-1]]) - 1e-9, 9)
    return Model(bias, tuple(trees), thresholds)


def _joined(spans: str) -> Column:
    """kind:start:end, comma-joined, by kind as listed and then by start."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> named_struct('at', array_position({kinds}, x.kind), "
                  "'start', x.start, 'end', x.end, 'kind', x.kind))), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, found per row of docs.

    Null and empty texts have no spans; repeated rows give equal rows and count as examples each; rows
    without an id are judged alike; an empty table gives no rows. Other columns are not read.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = staged(candidates(picked), "personal")
    model = fit(rows)
    chosen = " OR ".join(f"(x.kind = '{k}' AND {model.sql()} >= {v!r}D)" for k, v in model.thresholds.items()) or "false"
    added = F.expr(f"transform(filter(wide, x -> NOT x.label AND ({chosen})), x -> "
                   "named_struct('kind', x.kind, 'start', x.start, 'end', x.end))")
    judged = rows.select("doc_id", "base", added.alias("added")).select("doc_id", "base", F.expr(
        "filter(added, x -> x.kind <> 'number' OR NOT exists(added, y -> y.kind = 'national' AND y.start < x.end AND x.start < y.end))")
        .alias("added"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS]
    return judged.select(
        "doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("concat(base, added)").alias("spans"),
        F.size("added").cast("long").alias("n_added"), F.expr("concat(base, added)").alias("found"))
