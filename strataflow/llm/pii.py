"""Personal data: base patterns in linear time, and a conditional random field that adds spans.

The field labels tokens with word-shape features. Sequences are the surroundings of trigger tokens
(a digit, an at sign, or a bracketed "at" or "dot"): all other tokens can only be outside, so that
Viterbi runs over short sequences of a batch of documents at once. Its spans are added where they
touch no base span; base spans always stay.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_text
from .crf import CRF, bucket

KINDS = ("email", "ip", "card", "phone")
#: Most labelled rows the field is fitted on; a larger table is sampled down to it.
MAX_LABELLED = 4000
#: Tokens of context on each side of a trigger, looked up within this many characters.
CONTEXT_TOKENS, CONTEXT_CHARS = 3, 120

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A digit run is entered at its start only and never given back: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]+|[\[(](?:at|dot)[\])]", re.I)
_TOKEN = re.compile(r"[^\s]+")
_SPACE = re.compile(r"\s")
_EDGE = "\"'`.,;:!?<>[]{}()*#$%&|"


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign: a match starts where the run of local characters before it does."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive; matches that fail a test are dropped without a retry."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    if "@" in text:
        out["email"] = _emails(text)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                out["phone"].append(m.span())
    return out


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """Token spans around triggers; overlapping surroundings are one sequence."""
    found: list[tuple[int, int]] = []
    end = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        found.append((start, end))
    groups: list[list[tuple[int, int]]] = []
    done = -1  # end of the last token already in a sequence
    for i, (s, e) in enumerate(found):
        room = max(s - CONTEXT_CHARS, done, 0)
        before = [(a + room, b + room) for a, b in (m.span() for m in _TOKEN.finditer(text[room:s]))]
        if before and room and room != done and not text[room - 1].isspace():
            before = before[1:]
        before = before[-CONTEXT_TOKENS:]
        limit = found[i + 1][0] if i + 1 < len(found) else len(text)
        after = [m.span() for m in _TOKEN.finditer(text, e, min(limit, e + CONTEXT_CHARS))][:CONTEXT_TOKENS]
        touching = groups and (s - done < 2 or text[done:s].isspace() or (before and not text[done : before[0][0]].strip()))
        if touching:
            groups[-1] += [*before, (s, e), *after]
        else:
            groups.append([*before, (s, e), *after])
        done = groups[-1][-1][1]
    return groups


def shape(word: str) -> str:
    """Character classes, runs squeezed to at most two."""
    out: list[str] = []
    for c in word:
        x = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if out[-2:] != [x, x]:
            out.append(x)
    return "".join(out)


def token_features(words: list[str]) -> list[list[int]]:
    """Feature buckets of each token: shapes of itself and its neighbours, affixes, digit and mark counts."""
    shapes = ["^", *(shape(w) for w in words), "$"]
    low = ["^", *(w.lower() for w in words), "$"]
    out = []
    for i, w in enumerate(words, 1):
        digits = sum(c.isdigit() for c in w)
        core = w.strip(_EDGE).lower()
        out.append(
            [
                bucket(x)
                for x in (
                    "bias",
                    f"s={shapes[i]}",
                    f"s-={shapes[i - 1]}",
                    f"s+={shapes[i + 1]}",
                    f"c={core if not digits else 'digits'}",
                    f"w-={low[i - 1] if not any(c.isdigit() for c in low[i - 1]) else '9'}",
                    f"d={min(digits, 20)}",
                    f"at={'@' in w}{core in ('at', 'dot')}",
                    f"dots={min(w.count('.'), 4)}",
                    f"plus={w[:1] == '+'}{w[:1] == '('}{w.count('-')}",
                    f"tail={core[-4:] if not core[-1:].isdigit() else '9'}",
                )
            ]
        )
    return out


def labelled_rows(seed: int = 11, rows: int = 1200) -> list[tuple[list[str], list[str]]]:
    """A small labelled table, made by rule: tokens and their labels (O, or B-/I- and a kind)."""
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "ing", "ou", "st", "re", "on", "le", "de", "es", "que", "ar", "men", "ver", "sch"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    top = lambda: rng.choice(["com", "org", "net", "de", "fr", "es"])

    def card() -> str:
        head = "4" + digits(14)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def cased(mark: str) -> str:
        return rng.choice([str.lower, str.lower, str.upper])(mark)

    def plain() -> list[str]:
        return [word() + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randint(1, 5))]

    def groups(d: str, n: int) -> list[str]:
        return [d[i : i + n] for i in range(0, len(d), n)]

    positive = {
        "email": [
            lambda: [f"{word()}.{digits(2)}@{word()}.example.{top()}"],
            lambda: [word(), cased("[at]"), word(), cased("[dot]"), top()],
            lambda: [word(), cased("(at)"), word(), cased("(dot)"), top()],
            lambda: [f"{word()}{cased('[at]')}{word()}{cased('[dot]')}{top()}"],
            lambda: [f"{word()}@{word()}", f".{top()}"],
        ],
        "ip": [lambda: [rng.choice([".", ".", "[.]", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4))]],
        "card": [lambda: [card()], lambda: groups(card(), 4), lambda: ["-".join(groups(card(), 4))]],
        "phone": [
            lambda: ["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
            lambda: [f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
            lambda: [f"{digits(3)}-{digits(3)}-{digits(4)}"],
            lambda: [f"+{digits(2)}", digits(3), digits(3), digits(3)],
            lambda: [f"00{digits(2)}", digits(3), digits(7)],
        ],
    }
    negative = [
        lambda: [digits(rng.randint(1, 6))],
        lambda: [digits(4)],
        lambda: [f"{digits(1)}.{digits(2)}"],
        lambda: [f"{rng.randint(1900, 2030)}-{digits(2)}-{digits(2)}"],
        lambda: [f"{digits(2)}:{digits(2)}"],
        lambda: [f"{digits(3)},{digits(3)}"],
        lambda: ["token", "=", f'"{rng.getrandbits(160):040x}"'],
        lambda: [f"v{digits(1)}.{digits(1)}.{digits(1)}"],
        lambda: [f"{word()}{digits(2)}"],
        lambda: [f"@{word()}"],
        lambda: [f"({digits(1)})"],
        lambda: [f"{digits(2)}%"],
        lambda: [f"{word()}/{digits(3)}/{word()}.html"],
        lambda: [f"{rng.getrandbits(32):08x}-{rng.getrandbits(16):04x}-{rng.getrandbits(16):04x}"],
        lambda: [digits(rng.randint(17, 30))],
    ]
    out = []
    for _ in range(rows):
        tokens, tags = plain(), []
        tags = ["O"] * len(tokens)
        for _ in range(rng.randint(1, 2)):
            if rng.random() < 0.55:
                kind = rng.choice(KINDS)
                part = list(rng.choice(positive[kind])())
                tags += [f"B-{kind}", *([f"I-{kind}"] * (len(part) - 1))]
                if rng.random() < 0.2:
                    part[-1] += rng.choice([".", ",", ")", "!!", "***"])
            else:
                part = list(rng.choice(negative)())
                tags += ["O"] * len(part)
            more = plain()
            tokens += [*part, *more]
            tags += ["O"] * len(more)
        out.append((tokens, tags))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "tokens array<string>, tags array<string>")


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> CRF:
    """Fit on the labelled table (columns tokens, tags), or on at most ``max_rows`` of it by hash order."""
    rows = labelled.where("tokens is not null and tags is not null and size(tokens) = size(tags)")
    rows = rows.select("tokens", "tags").orderBy(F.xxhash64("tokens"), "tokens").limit(max_rows).collect()
    return train_rows([(list(r.tokens), list(r.tags)) for r in rows])


def train_rows(rows: list[tuple[list[str], list[str]]]) -> CRF:
    labels = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
    at = {x: i for i, x in enumerate(labels)}
    return CRF(labels).fit([token_features(t) for t, _ in rows], [[at.get(x, 0) for x in tags] for _, tags in rows])


def added_spans(model: CRF, texts: list[str | None], base: list[dict[str, list[tuple[int, int]]]]) -> list[list[tuple[str, int, int]]]:
    """What the field adds to the base spans, for a batch of texts."""
    owner, places, rows = [], [], []
    for i, text in enumerate(texts):
        for tokens in sequences(text) if text else []:
            owner.append(i)
            places.append(tokens)
            rows.append(token_features([text[a:b] for a, b in tokens]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, tokens, tags in zip(owner, places, model.decode(rows), strict=True):
        text, current = texts[i], None
        spans = []
        for (a, b), tag in zip(tokens, tags, strict=True):
            if tag[0] == "I" and current and current[0] == tag[2:]:
                current[2] = b
            elif tag == "O":
                current = None
            else:
                current = [tag[2:], a, b]
                spans.append(current)
        for kind, a, b in spans:
            while b > a and text[b - 1] in _EDGE:
                b -= 1
            while a < b and text[a] in _EDGE and not (kind == "phone" and text[a] == "("):
                a += 1
            if a < b and plausible(kind, text[a:b]) and (not out[i] or out[i][-1][2] <= a):
                out[i].append((kind, a, b))
    for i, spans in enumerate(out):
        if spans:
            taken = sorted(x for k in KINDS for x in base[i][k])
            starts = np.array([x[0] for x in taken])
            ends = np.maximum.accumulate(np.array([x[1] for x in taken])) if taken else starts
            free = lambda a, b: not len(starts) or (k := int(np.searchsorted(starts, b))) == 0 or ends[k - 1] <= a
            out[i] = [s for s in spans if free(s[1], s[2])]
    return out


# A plain address is the base pattern's; the field adds those whose dots are in brackets.
_MASKED_IP = re.compile(r"[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}")


def plausible(kind: str, text: str) -> bool:
    """A decoded span must carry what its kind cannot lack."""
    digits = [c for c in text if c in "0123456789"]
    if kind == "email":
        return bool(re.search(r"@|[\[(]at[\])]", text, re.I)) and bool(re.search(r"\.|[\[(]dot[\])]", text, re.I))
    if kind == "ip":
        return bool(_MASKED_IP.fullmatch(text)) and all(int(x) <= 255 for x in re.findall("[0-9]+", text))
    if re.search(r"[^0-9 ().+\t\n-]", text):
        return False
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn("".join(digits))
    return 9 <= len(digits) <= 15


def find_personal_data(docs: DataFrame, model: CRF, name: str = "personal_data") -> DataFrame:
    """``docs`` plus an array column (named ``name``, or another free name) of (kind, start, end, method).

    Null and empty texts have no spans; every row keeps its columns; texts are read whole.
    """
    kind = T.ArrayType(
        T.StructType(
            [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("method", T.StringType())]
        )
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets

    def make():
        field = sent.value

        def work(texts):
            base = [base_spans(t) for t in texts]
            more = added_spans(field, texts, base)
            out = []
            for b, m in zip(base, more, strict=True):
                spans = [(k, s, e, "base") for k in KINDS for s, e in b[k]] + [(*x, "field") for x in m]
                out.append([dict(zip(("kind", "start", "end", "method"), x, strict=True)) for x in spans])
            return [out]

        return work

    return map_text(docs, make, [T.StructField(free_name(docs, name), kind)])


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def pii_digest(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    found = find_personal_data(docs.select("doc_id", "text"), train(labelled), "found").select("doc_id", "found")
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]

    def make():
        def work(rows):
            columns: list[list] = [[] for _ in fields]
            for row in rows:
                base = [(x["kind"], x["start"], x["end"]) for x in row if x["method"] == "base"]
                for i, k in enumerate(KINDS):
                    columns[i].append(sum(x[0] == k for x in base))
                columns[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns[5].append(joined([(x["kind"], x["start"], x["end"]) for x in row]))
            return columns

        return work

    return map_text(found, make, fields, text="found", keep=["doc_id"])
