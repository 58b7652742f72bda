"""Personal information inside free text: found and replaced by typed placeholders (problem 6).

Method, weak supervision: wide patterns propose candidate spans of five types; labelers then vote on each
candidate for, against or not at all: regular expressions for the shape, the gazetteer of name parts, and
words to the left and right.  No labels are given, so expectation-maximisation estimates each labeler's
reliability per type from how the votes agree over *all* candidates.  Votes are few and discrete, so the fit
needs only the number of candidates per vote pattern, a table of bounded size (``MOST_PATTERNS`` =
3 ** labelers a type) that is counted with map-side aggregation over the whole corpus.  A logistic span
classifier is then trained on the resulting soft labels.  Beside the votes it sees what no labeler does: the
shape of the span, the words and characters next to it, hashed to ``FEATURES`` weights; it is fitted on at
most about ``TRAINING_SPANS`` candidates, a sample by hash, and scores all of them.  The spans that win are
kept, overlaps going to the type that cannot hold the other.  Texts are scanned once: spans are staged with
a digest of their text, and redaction joins them back.

Positions are 0-based code points.  Defined results: rows with a null id or null text have no spans; an
empty text has none; texts are processed whole; the same row delivered twice gives the same spans, once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.staging import Staging

TYPES = ["email", "phone", "id_number", "address", "name"]
LABELERS = 8
MOST_PATTERNS = 3**LABELERS

#: Hashed features of the span classifier, and candidates that it is trained on at most, about.
FEATURES = 1 << 12
TRAINING_SPANS = 200_000

#: Full-width digits, letters and signs that mentions are written with; one character for one.
_WIDE = {0xFF10 + i: 0x30 + i for i in range(10)} | {0xFF21 + i: 0x41 + i for i in range(26)} | {0xFF41 + i: 0x61 + i for i in range(26)}
_WIDE |= {0xFF0B: ord("+"), 0xFF0D: ord("-"), 0xFF20: ord("@"), 0x2010: ord("-"), 0x2011: ord("-"), 0xA0: 32, 0x3000: 32, 0xFF08: ord("("), 0xFF09: ord(")")}

_AT, _DOT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?)", r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
_EMAIL = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9_+%-]|\.(?=[A-Za-z0-9_+%-]))*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*", re.I)
_EMAIL_SHAPE = re.compile(rf".+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}$", re.I)
_NUMBER = re.compile(r"(?<![\w.@/-])(?<![A-Za-z])(?:\+\s?|\((?=\d))?\d(?:[ .()-]{0,2}\d){6,21}(?![\w@])")
_NUMBER_ZH = re.compile(r"(?:\+\s?|\((?=\d))?(?<!\d)\d(?:[ .()-]{0,2}\d){6,21}(?!\d)")
_PHONE_SHAPE = re.compile(
    r"^(?:(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-]?)\d{3}[ .-]?\d{4}"
    r"|(?:\+44 ?(?:\(0\) ?)?|0044 ?|\(?0)(?:\d{2}\)? ?\d{4} ?\d{4}|\d{3}\)? ?\d{3} ?\d{4}|\d{4}\)? ?\d{3} ?\d{3})"
    r"|(?:(?:\+|00)86[ -]?)?1[3-9]\d[ -]?\d{4}[ -]?\d{4})$"
)
_CODE = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}(?: ?\d){6,8}(?: ?[A-Z])?|\d{3}[- ]\d{2}[- ]\d{4}|\d{6} ?\d{8} ?\d{3}[\dXx]|\d{15})(?![A-Za-z0-9]|-\d)")
_ID_SHAPE = re.compile(r"^(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{1,2}\d{7,8}|\d{3}[- ]\d{2}[- ]\d{4}|[1-9]\d{5} ?(?:18|19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]) ?\d{3}[\dXx])$")

# Words that end a street, units, titles and kinship words, and cue words.
_STREET = r"Street|Str|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Court|Ct|Terrace|Drive|Dr|Way|Place|Pl|Square|Sq|Row|Hill|Crescent|Gardens|Grove|Boulevard|Blvd|Walk|Mews|Quay"
_UNIT = r"Flat|Unit|Apt|Apartment|Suite|Room|Studio"
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "madam", "coach", "aunt", "uncle", "cousin", "grandma", "grandpa", "mother", "father", "sister", "brother", "nurse", "doctor", "captain"}
_NOT_NAMES = _TITLES | {w.lower() for w in _STREET.split("|")} | {w.lower() for w in _UNIT.split("|")} | {"call", "reach", "lunch", "text", "cc", "note", "re", "update", "passport", "tax", "the", "and", "with", "old", "parcels", "backup", "handle", "please", "remember", "fyi", "build", "ticket", "checksum", "grace", "mark"} - {"grace", "mark"}

_ADDRESS = regex.compile(rf"(?:(?<![A-Za-z])(?:{_UNIT})\.? ?#?\d+[A-Z]?,? )?(?<![A-Za-z0-9.-])\d{{1,5}}[A-Z]? (?:[\w'’-]+ )?(?:\p{{Lu}}[\p{{L}}'’-]+ ){{1,3}}(?:{_STREET})(?![\p{{Latin}}-])", regex.I)
_ADDRESS_ZH = re.compile(r"(?=((?:[㐀-鿿]{2,4}?市)?(?:[㐀-鿿]{2,3}?[区县])?[㐀-鿿]{1,6}?[路街道巷弄]\d+号(?:\d+(?:栋|幢|号楼))?(?:\d+室)?))")
_CAP = r"\p{Lu}[\p{Latin}'’]+(?:-\p{Lu}[\p{Latin}'’]+)*"
_NAME = regex.compile(rf"(?<![\p{{Latin}}\d@.'’-])(?=({_CAP}(?: \p{{Lu}}\.| {_CAP})? {_CAP}|\p{{Lu}}\. {_CAP}|{_CAP}, {_CAP})(?![\p{{Latin}}@-]))")
_HAN = r"[㐀-鿿]"
_LEFT_ZH = re.compile(r"(?:联系人|[）)]由|找|收件人)$")
_RIGHT_ZH = re.compile(r"(?:电话|住在|核对|说|的电话|手机)")
_EDGE_ZH = re.compile(r"(?:^|[，。；：、！？「」（）()\"“”\s,.;:!?\d])$")

_LEFT = {
    "email": re.compile(r"(?:<|\bat |到|是|and |cc |mail |[:：])$", re.I),
    "phone": re.compile(r"(?:\bon |number |\bor |text \[|tel\.? |电话|打|备用号|手机|call )$", re.I),
    "id_number": re.compile(r"(?:passport |tax id |\bssn |national id |证件号|身份登记为[（(]|护照号?|身份证号?|form lists )$", re.I),
    "address": re.compile(r"(?:lives at |住在|寄到|go to |旧地址[「\"“]?|flat was [\"“]?|address |地址[：:]?)$", re.I),
    "name": re.compile(r"(?:\bcall |reach |lunch with |belongs to |\band |联系人|[）)]由|找|\b(?:mr|mrs|ms|miss|dr|prof|coach|aunt|uncle|cousin)\.? )$", re.I),
}
_RIGHT = {
    "email": re.compile(r"^(?:>|即可| and\b|[.,;，。；]|\s|$)", re.I),
    "phone": re.compile(r"^(?:找|\]| ext| or\b|[.,;，。；]|$)", re.I),
    "id_number": re.compile(r"^(?: belongs to|[）)]由|[.,;，。；]|$)", re.I),
    "address": re.compile(r"^(?:[.,;，。；\"”」]|$)", re.I),
    "name": re.compile(r"^(?: lives at| on [+(\d]| at \S+(?:@| ?[\[(]at)|住在|核对|电话|说)", re.I),
}
_THING = re.compile(r"(?:order|订单|工单|ticket|build|checksum|校验|session|编号|serial|model|version|dated|sku|part|invoice|展品|tracking|运单|快递单)\s?(?:no\.?|号|#|number)?[\s:：]*(?:\w+ )?$", re.I)


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


class Gazetteer:
    """The name parts of the lexicon table, an incomplete list."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.given = {p.lower() for p, kind in rows if p and kind == "given"}
        self.family = {p.lower() for p, kind in rows if p and kind == "family"}
        self.surname_zh = {p for p in self.family if re.match(_HAN, p)}


def candidates(text: str, names: Gazetteer) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(type, start, end, votes) of each candidate span of a text."""
    flat = text.translate(_WIDE)
    out: list[tuple[str, int, int, tuple[int, ...]]] = []

    def add(kind: str, start: int, end: int, *votes: int) -> None:
        before, after = flat[max(0, start - 24) : start], flat[end : end + 24]
        cues = (_vote(bool(_LEFT[kind].search(before))), _vote(bool(_RIGHT[kind].search(after))), _vote(False, bool(_THING.search(before))))
        out.append((kind, start, end, (cues + votes + (0,) * LABELERS)[:LABELERS]))

    if "@" in flat or "at" in flat:
        for m in _EMAIL.finditer(flat):
            span, before = m.group(), flat[max(0, m.start() - 1) : m.start()]
            shape = bool(_EMAIL_SHAPE.match(span))
            add("email", m.start(), m.end(), _vote(shape, not shape), _vote(not re.search(r"[@/:]", before + flat[m.end() : m.end() + 1]), True), _vote(bool(re.search(r"(?:example|invalid|test|com|net|org|edu|cn)$", span, re.I)), not shape))
    codes: list[tuple[int, int]] = []
    for m in _CODE.finditer(flat):
        span = m.group()
        shape = bool(_ID_SHAPE.match(span))
        digits = sum(c.isdigit() for c in span)
        add("id_number", m.start(), m.end(), _vote(shape, not shape), _vote(bool(re.search(r"belongs to|核对", flat[m.end() : m.end() + 30])), False), _vote(digits in (6, 7, 9, 18), True))
        if shape:
            codes.append((m.start(), m.end()))
    for m in (_NUMBER_ZH if re.search(_HAN, flat) else _NUMBER).finditer(flat):
        span = m.group()
        digits = sum(c.isdigit() for c in span)
        if span.startswith("(") and ")" not in span:
            continue
        shape = bool(_PHONE_SHAPE.match(span))
        taken = any(a < m.end() and m.start() < b for a, b in codes)
        add("phone", m.start(), m.end(), _vote(shape, not shape), _vote(10 <= digits <= 15, True), _vote(False, taken or bool(re.search(r"[A-Za-z0-9@/.-]$", flat[: m.start()][-1:]))))
    if re.search(r"\d", flat):
        for m in _ADDRESS.finditer(flat):
            span = m.group()
            proper = bool(regex.search(rf"\d+[A-Z]? (?:\p{{Lu}}[\p{{L}}'’-]+ ){{1,2}}(?:{_STREET})$", span))
            start = m.start()
            add("address", start, m.end(), _vote(proper, not regex.search(r"\p{Lu}", span)), _vote(bool(re.match(_UNIT, span, re.I)) or span[0].isdigit()), _vote(False, bool(re.search(r"[-.]$", flat[:start]))))
        at = 0
        for m in _ADDRESS_ZH.finditer(flat):
            if m.start() < at:
                continue
            span, start = m.group(1), m.start()
            area = re.search(r"[市区县]", span)
            if not area:
                continue
            # the area's name begins after a cue or a mark; a longer run before it is running text
            head = re.match(rf"{_HAN}*?(?:住在|寄到|送到|搬到|地址|位于|在|到)(?={_HAN}{{2,4}}[市区县])", span)
            if head:
                start += head.end()
                span = span[head.end() :]
            number = bool(re.search(r"[路街道巷弄]\d+号", span))
            add("address", start, m.end(1), _vote(number, True), _vote(bool(re.match(rf"{_HAN}{{2,3}}市{_HAN}{{2,3}}[区县]|{_HAN}{{2,3}}[市区县]", span))), _vote(bool(_EDGE_ZH.search(flat[max(0, start - 1) : start]))))
            at = m.end(1)
    for m in _NAME.finditer(flat):
        span, start = m.group(1), m.start()
        parts = [p.strip(".,") for p in re.split(r",? ", span)]
        low = [p.lower() for p in parts]
        words = [p for p in low if len(p) > 1]
        if len(words) == 3 and not all(p in names.given or p in names.family for p in words[:2]):
            # parts that nobody knows: the first two may still be a name
            span = span[: span.rindex(" ")]
            parts, low, words = parts[:2], low[:2], words[:2]
        if any(p in _NOT_NAMES for p in low):
            continue
        given, family = any(p in names.given for p in words), any(p in names.family for p in words)
        swapped = "," in span
        cued = bool(_LEFT["name"].search(flat[max(0, start - 24) : start]))
        if swapped:
            order = _vote(words[0] in names.family or words[-1] in names.given, words[0] in names.given and words[0] not in names.family)
        else:
            order = _vote(words[-1] not in names.given or words[-1] in names.family, True)
        shout = span.isupper() and len(words) > 1
        street = bool(re.search(r"\d[A-Z]? (?:[\w'’-]+ )?$", flat[max(0, start - 14) : start])) or bool(re.match(rf" (?:{_STREET})\b", flat[start + len(span) :]))
        add("name", start, start + len(span), _vote(given), _vote(family), order, _vote(False, street), _vote(swapped and given and family, not (given and family) and shout or swapped and not (given or family or cued)))
    if names.surname_zh and re.search(_HAN, flat):
        for i, c in enumerate(flat):
            if not "㐀" <= c <= "鿿":
                continue
            left = bool(_LEFT_ZH.search(flat[max(0, i - 3) : i]))
            known = c in names.surname_zh
            edge = left or i == 0 or bool(_EDGE_ZH.search(flat[i - 1]))
            if not (known or edge):
                continue
            for n in (2, 3):
                j = i + n
                span = flat[i:j]
                if len(span) < n or not re.fullmatch(_HAN + "+", span):
                    break
                rest, after = span[1:], flat[j : j + 4]
                right = bool(_RIGHT_ZH.match(after)) or (left and (not after or bool(re.match(r"[，。；、！？）)\s,.;]", after))))
                given = rest in names.given and (len(rest) > 1 or right)
                if not (right or given) or not (known or left or right and given):
                    continue
                add("name", i, j, _vote(given), _vote(known), _vote(right, not given), _vote(False, not edge and not given), _vote(right and edge, not right and not given))
    return out


_SIGN = {-1: "-", 0: "0", 1: "+"}
_LAST_WORD, _FIRST_WORD = regex.compile(r"(\p{Latin}+|[㐀-鿿]{1,2}|\p{N}+)[^\p{L}\p{N}]*$"), regex.compile(r"^[^\p{L}\p{N}]*(\p{Latin}+|[㐀-鿿]{1,2}|\p{N}+)")
_RUNS = [(re.compile(r"\d+"), "9"), (regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"\p{Ll}+"), "a"), (re.compile(r"[㐀-鿿]+"), "字")]


def shape(span: str) -> str:
    """Runs of one kind of character as one sign; other characters as they are."""
    for pattern, sign in _RUNS:
        span = pattern.sub(sign, span)
    return span[:24]


def features(flat: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed features of a candidate span: its shape and length, and the words and characters beside it."""
    span, before, after = flat[start:end], flat[max(0, start - 24) : start], flat[end : end + 24]
    left, right = _LAST_WORD.search(before), _FIRST_WORD.search(after)
    said = [f"shape {shape(span)}", f"length {min(len(span), 40) // 2}", f"left {left.group(1).lower() if left else ''}", f"right {right.group(1).lower() if right else ''}", f"before {shape(before[-1:])}", f"after {shape(after[:1])}", f"words {len(span.split())}"]
    return [xxhash.xxh32_intdigest(f"{kind} {x}") % FEATURES for x in said]


_SPANS = "row_id string, digest binary, pii_type string, start_pos long, end_pos long, votes string, features array<int>"


def _patterns(names: Gazetteer):
    """(row_id, content) to candidate spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32())]
        for batch in batches:
            rows: list[tuple] = []
            for row_id, text in zip(batch.column("row_id").to_pylist(), batch.column("content").to_pylist()):
                found = candidates(text, names)
                if found:
                    flat, digest = text.translate(_WIDE), _digest(text)
                    rows += [(row_id, digest, kind, a, b, "".join(map(_SIGN.get, votes)), features(flat, kind, a, b)) for kind, a, b, votes in found]
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=["row_id", "digest", "pii_type", "start_pos", "end_pos", "votes", "features"])

    return run


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def estimate_reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior of each pattern, prior, P(vote | class) of shape labelers x 2 x 3) by expectation-maximisation."""
    # begun from the votes' own sense, which also says which class is which: labelers that agree more often than not can't be all turned round
    q = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    prior, table = 0.5, np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        prior = float(np.clip((q * counts).sum() / counts.sum(), 0.01, 0.99))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                hit = votes[:, j] == v
                table[j, 1, v + 1] = (q * counts)[hit].sum() + 1
                table[j, 0, v + 1] = ((1 - q) * counts)[hit].sum() + 1
            table[j] /= table[j].sum(axis=1, keepdims=True)
        logs = np.log(prior) - np.log(1 - prior) + sum(np.log(table[j, 1, votes[:, j] + 1]) - np.log(table[j, 0, votes[:, j] + 1]) for j in range(votes.shape[1]))
        after = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
        if np.abs(after - q).max() < 1e-6:
            q = after
            break
        q = after
    return q, prior, table


def _inputs(votes: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Indexes of the weights that are on, of shape spans x inputs: the bias, for and against each labeler, hashed features; -1 is none."""
    j = np.arange(votes.shape[1])
    on = np.where(votes == 1, 1 + j, np.where(votes == -1, 1 + votes.shape[1] + j, -1))
    return np.concatenate([np.zeros((len(votes), 1), dtype=np.int64), on, hashed.astype(np.int64) + 1 + 2 * votes.shape[1]], axis=1)


def train_classifier(votes: np.ndarray, hashed: np.ndarray, counts: np.ndarray, soft: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic classifier of votes and hashed features, by diagonally scaled gradient steps; hashed ones are held back more."""
    on = _inputs(votes, hashed)
    size = 1 + 2 * votes.shape[1] + FEATURES
    flat, weight = np.where(on < 0, size, on), counts / counts.sum()
    w, total = np.zeros(size + 1), np.full(size + 1, 1e-4)
    hold = np.r_[np.full(1 + 2 * votes.shape[1], 1e-5), np.full(FEATURES, 5e-4), 0.0]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[flat].sum(axis=1), -30, 30)))
        gradient = np.bincount(flat.ravel(), weights=np.repeat(weight * (p - soft), flat.shape[1]), minlength=size + 1) + hold * w
        gradient[-1] = 0.0
        total += gradient**2
        w -= 0.5 * gradient / np.sqrt(total)
    return w[:-1]


def classify(w: np.ndarray, votes: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Classifier score of each span."""
    on = _inputs(votes, hashed)
    return 1 / (1 + np.exp(-np.clip(np.where(on < 0, 0.0, w[on]).sum(axis=1), -30, 30)))


_BACK = {"-": -1, "0": 0, "+": 1}


def _votes(texts: list[str]) -> np.ndarray:
    return np.array([[_BACK[c] for c in v] for v in texts], dtype=np.int64).reshape(-1, LABELERS)


def fit_types(table: list[tuple[str, str, int]], sample: list[tuple[str, str, list[int], int]]) -> dict[str, np.ndarray]:
    """Classifier weights of each type from (pii_type, votes, count) of all candidates and (pii_type, votes, features, count) of the sample."""
    out: dict[str, np.ndarray] = {}
    for kind in TYPES:
        mine = sorted((v, n) for k, v, n in table if k == kind)
        drawn = sorted((v, f, n) for k, v, f, n in sample if k == kind)
        if not mine or not drawn:
            continue
        soft, _, _ = estimate_reliabilities(_votes([v for v, _ in mine]), np.array([n for _, n in mine], dtype=float))
        label = {v: q for (v, _), q in zip(mine, soft)}
        out[kind] = train_classifier(_votes([v for v, _, _ in drawn]), np.array([f for _, f, _ in drawn]), np.array([n for _, _, n in drawn], dtype=float), np.array([label[v] for v, _, _ in drawn]))
    return out


def resolve(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Spans without overlaps: emails and addresses hold names, identity numbers hold digits; then the score, then the length."""
    rank = {"email": 0, "address": 1, "id_number": 2, "phone": 3, "name": 4}
    spans = [s for s in spans if not any(s[0] == t[0] and t[1] <= s[1] and s[2] <= t[2] and t[2] - t[1] > s[2] - s[1] for t in spans)]
    kept: list[tuple[str, int, int]] = []
    for kind, a, b, score in sorted(spans, key=lambda s: (rank[s[0]], -round(s[3], 2), s[1] - s[2], s[1])):
        if all(b <= x or y <= a for _, x, y in kept):
            kept.append((kind, a, b))
    return sorted(kept, key=lambda s: s[1])


def _rows(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "content").filter("row_id IS NOT NULL AND content IS NOT NULL")


def fit(rows: DataFrame, lexicon: DataFrame) -> tuple[dict[str, np.ndarray], DataFrame]:
    """(classifier weights of each type, the candidates of ``rows(row_id, content)``, staged).

    ``lexicon(name_part, kind)`` is a fixed table of about a hundred rows.
    """
    names = Gazetteer([(r["name_part"], r["kind"]) for r in lexicon.select("name_part", "kind").collect()])
    stage = Staging(rows.sparkSession, "personal-information")
    spans = stage.cut(_rows(rows).mapInArrow(_patterns(names), _SPANS))
    table = [(r["pii_type"], r["votes"], r["n"]) for r in spans.groupBy("pii_type", "votes").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 5 * MOST_PATTERNS rows
    share = min(1.0, TRAINING_SPANS / max(1, sum(n for _, _, n in table)))
    drawn = spans.filter(F.pmod(F.xxhash64("row_id", "digest", "start_pos", "end_pos"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = drawn.groupBy("pii_type", "votes", "features").agg(F.count(F.lit(1)).alias("n")).collect()  # about TRAINING_SPANS rows at most
    return fit_types(table, [(r["pii_type"], r["votes"], list(r["features"]), r["n"]) for r in sample]), spans


def _scored(weights: dict[str, np.ndarray]):
    """Spans to those that the classifier takes, with their score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(len(batch))
            kinds = np.array(batch.column("pii_type").to_pylist(), dtype=object)
            votes = _votes(batch.column("votes").to_pylist())
            hashed = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for kind, w in weights.items():
                mine = np.flatnonzero(kinds == kind)
                if len(mine):
                    score[mine] = classify(w, votes[mine], hashed[mine])
            names = ["row_id", "digest", "pii_type", "start_pos", "end_pos"]
            out = pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(score)], names=[*names, "score"])
            yield out.filter(pa.array(score >= 0.5))

    return run


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, digest, spans) to the spans that are left of each text."""
    kind = pa.list_(pa.struct([("pii_type", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]))
    for batch in batches:
        kept = []
        for spans in batch.column("spans").to_pylist():
            left = resolve([(x["pii_type"], x["start_pos"], x["end_pos"], x["score"]) for x in spans])
            kept.append([{"pii_type": k, "start_pos": a, "end_pos": b} for k, a, b in left])
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("digest"), pa.array(kept, type=kind)], names=["row_id", "digest", "kept"])


def _kept(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(row_id, digest, kept): the mentions of each text that has any, in order."""
    weights, spans = fit(rows, lexicon)
    scored = spans.mapInArrow(_scored(weights), "row_id string, digest binary, pii_type string, start_pos long, end_pos long, score double")
    grouped = scored.groupBy("row_id", "digest").agg(F.collect_set(F.struct("pii_type", "start_pos", "end_pos", "score")).alias("spans"))
    return grouped.mapInArrow(_resolved, "row_id string, digest binary, kept array<struct<pii_type: string, start_pos: long, end_pos: long>>")


def find_spans(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(row_id, pii_type, start_pos, end_pos): each mention once; with several texts of one id, those of each."""
    return _kept(rows, lexicon).select("row_id", F.inline("kept")).distinct()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest = pa.array([None if t is None else _digest(t) for t in batch.column("content").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, digest], names=["row_id", "content", "digest"])


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("content").to_pylist()
        for i, spans in enumerate(batch.column("kept").to_pylist()):
            if spans and texts[i] is not None:
                out, at = [], 0
                for x in spans:
                    out += [texts[i][at : x["start_pos"]], f"[{x['pii_type'].upper()}]"]
                    at = x["end_pos"]
                texts[i] = "".join(out) + texts[i][at:]
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(texts, pa.string())], names=["row_id", "content"])


def redact(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(row_id, content): each text with its mentions replaced by [TYPE]; null texts stay null, and texts without an id as they are."""
    named = rows.select("row_id", "content").mapInArrow(_digests, "row_id string, content string, digest binary")
    # the found spans grow with the texts, so this is a merge at every size
    return named.join(_kept(rows, lexicon).hint("merge"), ["row_id", "digest"], "left").select("row_id", "content", "kept").mapInArrow(_replaced, "row_id string, content string")
