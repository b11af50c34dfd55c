"""Personal data by weak supervision.

Candidates are the base spans and spans of looser patterns. Five labelers vote on each: its
pattern, its validity, a gazetteer, the words before it and its edges. Expectation-maximisation
over the counts of all vote patterns in the corpus estimates how reliable each labeler is and
how likely each pattern is personal data. These soft labels train the final span classifier, a
logistic regression on features that the labelers don't see: form, neighbours and the word before
a span. Base spans stay; other candidates become spans if it accepts them.

All patterns take time in proportion to the text: the ones that could start anywhere in a run of
letters or digits are matched outwards from a mark or from the start of a run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm._shared import Taken, settle, text_or_empty

KINDS = ("email", "ip", "card", "phone", "email_spelled", "phone_local", "national_id", "person")
#: The patterns of the base kinds. Of email, what may stand before and follow the
#: sign; of ip, only starts of runs of digits need a look.
BEFORE_AT, AFTER_AT = "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123)))) + "._%+-", re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The looser ones.
SPELLED_BEFORE, SPELLED = BEFORE_AT.replace("%+", ""), re.compile(r"[\[(]at[\])] ?[A-Za-z0-9-]+ ?[\[(]dot[\])] ?[A-Za-z]{2,}")
PHONE_LOCAL = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
NATIONAL_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
PERSON = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?")
#: Gazetteers. Country domains have two letters and need no list; these are the generic ones.
DOMAINS = frozenset("com org net edu gov mil int info biz name pro mobi asia jobs travel museum coop aero tel cat post app dev blog shop online site tech store cloud email example".split())
#: Calling codes: of one and two digits, and the first two digits of those of three.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ZONES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Common given names in English, German, French and Spanish.
GIVEN = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony margaret mark sandra "
    "donald ashley steven kimberly paul emily andrew donna joshua michelle kenneth carol kevin amanda brian melissa george deborah edward stephanie anna peter hans karl julia maria laura jürgen klaus wolfgang ursula "
    "monika petra sabine gisela helga renate brigitte andreas stefan christian martin werner dieter frank uwe ralf heike ingrid claudia katrin anja jean marie pierre luis françois nathalie isabelle sylvie "
    "catherine martine christine françoise valérie sandrine véronique philippe michel alain patrick nicolas christophe laurent sophie chantal jacques andré camille josé ana carmen antonio manuel francisco juan javier "
    "miguel ángel carlos jesús alejandro pablo sergio fernando isabel dolores pilar teresa rosa cristina marta lucía elena raquel beatriz rocío diego jorge alberto álvaro adrián ramón rafael enrique".split()
)
HINTS = re.compile(r"(?i)mail|contact|phone|call|tel|mobile|fax|card|visa|credit|addr|host|server|name|ssn|social|patient|write to")
DOUBTS = re.compile(r"(?i)version|isbn|issn|order|invoice|figure|table|section|build|doi|patent")
LABELERS = 5
#: Values of each feature of a span: kind, length, share of digits, separators, case, the characters
#: on both sides, and a hash of the word before. Their product bounds what training gathers.
SIZES = (len(KINDS), 4, 4, 5, 3, 4, 4, 16)
LAST_WORD = re.compile(r"(\w+)\W*\Z")
SCAN = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans array<struct<start:int,kind:int,end:int,pattern:int,features:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: int, text: str) -> bool:
    """Whether a match of a base pattern is a base span."""
    if kind == 1:
        return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))
    digits = digits_of(text) if kind else ""
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == 3 else True


def votes(kind: int, text: str, start: int, end: int) -> int:
    """The votes of the five labelers on a span as digits of base 3: 0 against, 1 none, 2 for."""
    span = text[start:end]
    digits = digits_of(span)
    pattern = 2 if kind < 4 else 1
    if kind == 1:
        sound = 2 if span.split(".")[0] not in ("0", "127", "255") and len(digits) > 5 else 0
    elif kind in (2, 3, 5):
        sound = 2 if len(set(digits)) > 2 else 0
    elif kind == 6:
        sound = 2 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" else 0
    else:
        sound = 1
    if kind in (0, 4):
        ending = re.split(r"[^A-Za-z]+", span[-64:].rstrip(")]"))[-1].lower()
        listed = 2 if len(ending) == 2 or ending in DOMAINS else 0
    elif kind == 3:
        listed = 2 if digits[:1] in CALLING or digits[:2] in CALLING or digits[:2] in ZONES else 0
    elif kind == 7:
        listed = 2 if any(w.lower() in GIVEN for w in span.split()[1:]) else 1
    else:
        listed = 1
    before = text[max(0, start - 40) : start]
    context = 2 if HINTS.search(before) else 0 if DOUBTS.search(before) else 1
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = 0 if left.isalnum() or right.isalnum() else 2
    return (((pattern * 3 + sound) * 3 + listed) * 3 + context) * 3 + edges


def features(kind: int, text: str, start: int, end: int) -> int:
    """The features of a span as digits of the mixed base ``SIZES``."""
    from zlib import crc32

    span = text[start:end]
    n, digits = len(span), sum("0" <= c <= "9" for c in span)
    length = (n > 8) + (n > 12) + (n > 20)
    share = 0 if digits == 0 else 1 + (2 * digits >= n) + (10 * digits >= 9 * n)
    marks = [i for i, c in enumerate("-. ") if c in span]
    separators = 0 if not marks else marks[0] + 1 if len(marks) == 1 else 4
    case = 0 if not any(map(str.isalpha, span)) else 1 + any(map(str.isupper, span))
    side = lambda c: 0 if c in ("", "\n") else 1 if c.isspace() else 2 if not c.isalnum() else 3
    word = LAST_WORD.search(text[max(0, start - 40) : start])
    out = 0
    for size, value in zip(SIZES, (kind, length, share, separators, case, side(text[start - 1 : start] if start else ""), side(text[end : end + 1]), crc32(word.group(1).lower().encode()) % 15 + 1 if word else 0), strict=True):
        out = out * size + value
    return out


def around(text: str, marks, before: str, blank: bool):
    """(start, end) of leftmost, non-overlapping spans: a run of the characters ``before``, for
    some after a blank, and a match of ``marks``."""
    done = 0
    for m in marks:
        at = m.start()
        head = text[done:at]
        if blank and head.endswith(" "):
            head = head[:-1]
        run = len(head) - len(head.rstrip(before))
        if run:
            yield done + len(head) - run, m.end()
            done = m.end()
        else:
            done = at + 1  # no run reaches across the mark


def matches(kind: int, text: str):
    """(start, end) of all matches of a kind's pattern."""
    if kind == 0:
        found = around(text, AFTER_AT.finditer(text), BEFORE_AT, False) if "@" in text else ()
    elif kind == 4:
        found = around(text, SPELLED.finditer(text), SPELLED_BEFORE, True) if "[at]" in text or "(at)" in text else ()
    else:
        found = (m.span() for m in {1: IP, 2: CARD, 3: PHONE, 5: PHONE_LOCAL, 6: NATIONAL_ID, 7: PERSON}[kind].finditer(text))
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all candidates by start, then kind; looser ones don't touch base ones."""
    numbers = any(c in text for c in "0123456789")
    found = []
    for kind in range(len(KINDS)):
        if (kind == 3 and "+" not in text) or (kind in (1, 2, 5, 6) and not numbers):
            continue
        taken = Taken((s, e) for s, _, e in found) if kind > 3 else None
        for start, end in matches(kind, text):
            if not taken.touches(start, end) if taken else valid(kind, text[start:end]):
                found.append((start, kind, end))
    return sorted(found)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with all its candidates and their votes (``SCAN``)."""

    def kernel(batches):
        import pyarrow as pa

        span = pa.struct([(n, pa.int32()) for n in ("start", "kind", "end", "pattern", "features")])
        for rows in batches:
            counts, bases, spans = [], [], []
            for text in rows.column(1):
                text = text.as_py()
                found = candidates(text)
                counts.append([sum(k == kind for _, k, _ in found) for kind in range(4)])
                bases.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found if k < 4))
                spans.append([{"start": s, "kind": k, "end": e, "pattern": k * 3**LABELERS + votes(k, text, s, e), "features": features(k, text, s, e)} for s, k, e in found])
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(bases, pa.string()), pa.array(spans, pa.list_(span))], [c.split()[0] for c in SCAN.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(kernel, SCAN)


def reliabilities(patterns, counts, rounds: int = 60):
    """Expectation-maximisation over vote patterns. patterns: (n, labelers) of 0, 1, 2. Returns
    the posterior of each pattern and the vote probabilities (class, labeler, vote)."""
    import numpy as np

    n, d = patterns.shape
    theta = np.tile(np.array([[[0.5, 0.3, 0.2]], [[0.2, 0.3, 0.5]]]), (1, d, 1))
    prior, posterior = 0.5, np.full(n, 0.5)
    for _ in range(rounds if n else 0):
        log = np.stack([np.log([1 - prior, prior][c]) + sum(np.log(theta[c, j, patterns[:, j]]) for j in range(d)) for c in (0, 1)])
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        for c, p in enumerate((1 - posterior, posterior)):
            for j in range(d):
                got = np.bincount(patterns[:, j], p * counts, 3) + 1
                theta[c, j] = got / got.sum()
        prior = float(np.clip((posterior * counts).sum() / counts.sum(), 0.02, 0.98))
    return posterior, theta


def fit_classifier(x, target, weights, rounds: int = 40, ridge: float = 1.0):
    """Logistic regression on soft targets by Newton steps; the last weight is the intercept."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weights * (target - p)) - ridge * w
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


def votes_of(patterns):
    """The votes of patterns, one column for each labeler."""
    import numpy as np

    rest = np.asarray(patterns, dtype=np.int64) % 3**LABELERS
    return np.stack([rest // 3**j % 3 for j in reversed(range(LABELERS))], axis=1)


def learned_weights(found: DataFrame) -> list[list[float]]:
    """The weight of each value of each feature, and an intercept in a list of its own; empty if
    there are no candidates.

    Two passes over all candidates. The first counts vote patterns (at most kinds x 3^labelers,
    1,944); the second sums soft labels over feature codes (at most the product of ``SIZES``,
    491,520 rows of three numbers): neither grows with the documents beyond that.
    """
    import numpy as np

    spans = found.select(F.explode("spans").alias("s")).select("s.pattern", "s.features")
    rows = spans.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow().to_pydict()
    if not rows["n"]:
        return []
    posterior, _ = reliabilities(votes_of(rows["pattern"]), np.array(rows["n"], dtype=np.float64))
    soft = found.sparkSession.createDataFrame([(p, float(q)) for p, q in zip(rows["pattern"], posterior, strict=True)], "p int, soft double")
    labelled = spans.join(F.broadcast(soft), F.col("pattern") == F.col("p"))
    rows = labelled.groupBy("features").agg(F.count("*").alias("n"), F.avg("soft").alias("soft")).orderBy("features").toArrow().to_pydict()
    left, columns = np.array(rows["features"], dtype=np.int64), []
    for size in reversed(SIZES):
        left, value = np.divmod(left, size)
        columns.append(np.eye(size)[value])
    w = fit_classifier(np.hstack(columns[::-1]), np.array(rows["soft"]), np.array(rows["n"], dtype=np.float64))
    ends = np.cumsum(SIZES)
    return [*(part.tolist() for part in np.split(w[:-1], ends[:-1])), [float(w[-1])]]


def accepted(features: Column, weights: list[list[float]], threshold: float) -> Column:
    """Whether the classifier gives a span at least ``threshold``: a sum of looked-up weights."""
    from math import inf, log

    total, below = F.lit(weights[-1][0]), 1
    for size, part in reversed(list(zip(SIZES, weights, strict=False))):
        value = F.floor(features / below) % size
        total, below = total + F.element_at(F.array(*map(F.lit, part)), (value + 1).cast("int")), below * size
    return total >= (log(threshold / (1 - threshold)) if 0 < threshold < 1 else inf if threshold else -inf)


def find_personal_data(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, ``base`` (kind:start:end of the
    base spans by start, then kind) and ``spans``: an array of start, kind, end for the base
    spans and all other candidates that the classifier accepts; code points, end exclusive.

    Null text is empty text; rows that repeat repeat; an empty table gives no row; columns other
    than doc_id and text are not read.
    """
    found = settle(scan(docs), "personal")
    weights, names = learned_weights(found), F.array(*map(F.lit, KINDS))
    chosen = F.filter("spans", lambda s: (s["kind"] < 4) | accepted(s["features"], weights, threshold)) if weights else F.col("spans")
    shown = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), names[s["kind"]].alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", shown.alias("spans"))
