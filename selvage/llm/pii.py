"""Personal data: base patterns and a semi-Markov conditional random field over candidate segments.

The base finds e-mail addresses, IP addresses, card and telephone numbers by pattern, in time linear in the text. Around
digits, @ and (at), the text is cut into atoms (runs of letters or digits, white space, single
signs); segments of at most MOST_ATOMS atoms, and longer whole runs of letters and digits that look like keys, are scored as a whole by the features of the span and its surroundings, and
dynamic programming chooses boundaries and types together, or no entity. Its spans are added to the base's.

The field is trained here by maximum likelihood on generated sentences; their number is the parameter `sentences`.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.llm.common import tune

KINDS = ("email", "ip", "card", "phone", "secret")
#: Longest segment, but for whole runs that look like keys.
MOST_ATOMS, MOST_CHARS = 24, 96
#: Characters kept on either side of what starts a window.
MARGIN = 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGNS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, end (code points), place in KINDS, in order of start and kind: leftmost matches of each kind, without the
    failing ones."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((left, m.end(), 0))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)
    if _SIGNS.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- the field -------------------------------------------------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@(\[][0-9]*")
_ATOM = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
_ALNUM = re.compile(r"[A-Za-z0-9]+")
_HEX = re.compile(r"[0-9A-Fa-f]{20,}|[A-Za-z0-9_]*(?=[A-Za-z0-9_]*[0-9])(?=[A-Za-z0-9_]*[A-Za-z])[A-Za-z0-9_]{16,}")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HIDDEN = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIAL = re.compile(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,5}\)?[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4})+|\+[0-9][ ().0-9-]+[0-9]")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
#: Words before a span that announce a kind.
CUES = (("mail", "email", "write", "contact"), ("ip", "host", "server", "address"), ("card", "visa", "iban", "account"), ("tel", "phone", "call", "fax", "mobile"), ("token", "secret", "password", "passwd", "key", "apikey", "api"))


def features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that hold for text[start:end] as one segment."""
    s = text[start:end]
    n = sum("0" <= c <= "9" for c in s)
    out = [0]
    out.append(1 + (0 if n == 0 else 1 if n < 4 else 2 if n < 7 else 3 if n < 10 else 4 if n < 13 else 5 if n < 14 else 6 if n < 16 else 7 if n == 16 else 8 if n < 20 else 9))
    if _NUMBER.fullmatch(s):
        out.append(11)
        if 13 <= n <= 19 and luhn(_digits(s)):
            out.append(12)
    if _EMAIL.fullmatch(s):
        out.append(13)
    if _HIDDEN.fullmatch(s):
        out.append(14)
    if _QUAD.fullmatch(s):
        out.append(15 if all(int(x) <= 255 for x in s.split(".")) else 16)
    if _DIAL.fullmatch(s):
        out.append(17)
        if s[0] == "+":
            out.append(18)
        if "(" in s:
            out.append(19)
        if 10 <= n <= 15:
            out.append(20)
    if _HEX.fullmatch(s):
        out.append(21)
    if start and (text[start - 1].isalnum() or text[start - 1] in ".@+-_" and not text[start - 1].isspace()):
        out.append(22)
    if end < len(text) and (text[end].isalnum() or text[end] in "@_-" or text[end] == "." and end + 1 < len(text) and text[end + 1].isalnum()):
        out.append(23)
    if start and text[start - 1] in "\"'" and end < len(text) and text[end] == text[start - 1]:
        out.append(24)
    before = re.findall(r"[a-z]+", text[max(0, start - 24) : start].lower())[-3:]
    for k, cue in enumerate(CUES):
        if any(w in cue for w in before):
            out.append(25 + k)
    if s[0] in " \t\r\n" or s[-1] in " \t\r\n.,;:-":
        out.append(30)
    if re.search(r"[^\W\d_]{2,} [^\W\d_]{2,}", s):
        out.append(31)
    # conjunctions that single weights cannot express
    if 21 in out and 29 in out:
        out.append(32)
    if 12 in out and 14 <= n <= 19:
        out.append(33)
    if 17 in out and 28 in out:
        out.append(34)
    if 11 in out and 27 in out and 14 <= n <= 19:
        out.append(35)
    return out


N_FEATURES = 36


def windows(text: str) -> list[tuple[int, int]]:
    """Parts of a text around what may belong to an entity, widened to whole atoms' margins and merged."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if m[0] in "([" and text[m.end() : m.end() + 3] not in ("at)", "at]"):
            continue
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        while a and text[a - 1].isalnum() and m.start() - a < 4 * MARGIN:
            a -= 1
        while b < len(text) and text[b].isalnum() and b - m.end() < 4 * MARGIN:
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Bounds of the atoms of a window, and segments (first atom, atom after the last) that may be an entity.

    A whole run of letters and digits that looks like a key and is beyond the bounds of a segment is one atom.
    """
    bounds = [start, *(m.end() for m in _ATOM.finditer(text, start, end))]
    whole = set()
    for m in _ALNUM.finditer(text, start, end):
        a, b = m.span()
        if b - a <= MOST_ATOMS or a and text[a - 1].isalnum() or b < len(text) and text[b].isalnum():
            continue
        i, j = bisect.bisect_left(bounds, a), bisect.bisect_left(bounds, b)
        if (j - i > MOST_ATOMS or b - a > MOST_CHARS) and _HEX.fullmatch(text, a, b):
            whole.add((a, b))
    if whole:
        inner = np.zeros(end - start + 1, dtype=bool)
        for a, b in whole:
            inner[a + 1 - start : b - start] = True
        bounds = [b for b in bounds if not inner[b - start]]
    segments = []
    n = len(bounds) - 1
    for i in range(n):
        first = text[bounds[i]]
        if not (first.isalnum() or first in "+(") or i and text[bounds[i] - 1].isalnum():
            continue
        digits = at = False
        for j in range(i + 1, min(n, i + MOST_ATOMS) + 1):
            atom = text[bounds[j - 1] : bounds[j]]
            if (bounds[i], bounds[j]) in whole:
                segments.append((i, j))
                digits = True
                continue
            if bounds[j] - bounds[i] > MOST_CHARS or "\n" in atom:
                break
            digits |= "0" <= atom[0] <= "9" or (bounds[j - 1], bounds[j]) in whole
            at |= atom == "@" or atom == "at"
            last = atom[-1]
            if not (digits or at) or not last.isalnum() and last not in "])" or bounds[j] < len(text) and text[bounds[j]].isalnum() and last.isalnum():
                continue
            if at or "." in text[bounds[i] : bounds[j]] or j - i == 1 or all(c in "0123456789 +().-" for c in text[bounds[i] : bounds[j]]) or _HEX.fullmatch(text, bounds[i], bounds[j]):
                segments.append((i, j))
    return bounds, segments


class Field:
    """Weights of a semi-Markov conditional random field: features by kind, and moves from label to label.

    A segment of KINDS[k] has label k + 1; label 0 is a single atom outside any entity and has no features. moves[e, l]:
    into label l, after an atom outside (e = 0) or after an entity (e = 1).
    """

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """The best segmentation's entities: start, end, kind."""
        bounds, segments = candidates(text, start, end)
        ending: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, j in segments:
            score = self.weights[features(text, bounds[i], bounds[j])].sum(axis=0)
            if score.max() > -4:  # else no context lifts it
                ending.setdefault(j, []).append((i, score))
        if not ending:
            return []
        n = len(bounds) - 1
        best = [[0.0, -np.inf]]  # outside, after an entity
        back: list[list] = [[None, None]]
        moves = self.moves.tolist()
        for j in range(1, n + 1):
            out, ent = best[j - 1][0] + moves[0][0], best[j - 1][1] + moves[1][0]
            row, how = [max(out, ent), -np.inf], [(j - 1, int(ent > out), 0), None]
            for i, score in ending.get(j, ()):
                for e in (0, 1):
                    value = best[i][e] + self.moves[e, 1:] + score
                    k = int(value.argmax())
                    if value[k] > row[1]:
                        row[1], how[1] = float(value[k]), (i, e, k + 1)
            best.append(row)
            back.append(how)
        j, state, out = n, int(best[n][1] > best[n][0]), []
        while j:
            i, before, label = back[j][state]
            if label:
                out.append((bounds[i], bounds[j], label - 1))
            j, state = i, before
        return out[::-1]


def _sentences(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts with their entities, and with numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(rng.choice(list("aeinorstlhdu"), rng.integers(2, 9)))
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def checked(n: int, good: bool) -> str:
        d = num(n - 1)
        c = next(c for c in "0123456789" if luhn(d + c))
        return d + (c if good else str((int(c) + int(rng.integers(1, 10))) % 10))

    def entity() -> tuple[str, str, int]:
        kind = rng.integers(9)
        if kind == 0:
            return pick("", "", "mail "), f"{word()}{pick('', '.' + word(), '.' + num(2), '_' + num(1))}@{word()}{pick('', num(1))}.{word()}{pick('', '.com', '.org')}", 0
        if kind == 1:
            return "", f"{word()}{pick('[at]', ' [at] ', ' (at) ')}{word()}{pick('.', ' [dot] ')}{word()}", 0
        if kind == 2:
            return pick("", "", "host "), ".".join(str(rng.integers(0, 256)) for _ in range(4)), 1
        if kind in (3, 4):
            d = checked(int(pick(14, 15, 16, 16, 16, 19)), True)
            return pick("", "", "card "), pick(d, d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))), 2
        if kind == 5:
            return pick("", "", "tel "), f"+{pick('1', '44', '49')} " + pick(f"({num(3)})", num(3)) + f" {num(3)}-{num(4)}", 3
        if kind == 6:
            return pick("", "", "call "), pick(f"({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"+{num(11)}"), 3
        if kind == 7:
            return "call " + pick("", "us "), f"{num(3)}-{num(3)}-{num(4)}", 3
        return pick('token = "', 'secret: "', 'api_key="', "token = '"), "".join(rng.choice(list("0123456789abcdef"), int(pick(32, 40, 64)))), 4

    def other() -> str:
        return pick(num(int(rng.integers(1, 13))), checked(int(rng.integers(13, 20)), False), checked(16, False), f"{num(4)}-{num(2)}-{num(2)}", f"{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 99)}", f"{num(2)}:{num(2)}", f"{num(3)},{num(3)}.{num(2)}", f"{rng.integers(256, 999)}.{num(3)}.{num(3)}.{num(3)}", f"{num(3)} {num(4)}", f"{num(3)}-{num(4)}", f"{word()}{num(3)}", "sha1 " + "".join(rng.choice(list("0123456789abcdef"), 40)), f"@{word()}", "token", f"{num(5)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}")

    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rng.integers(1, 5))) + " ", []
        for _ in range(rng.integers(1, 4)):
            if rng.random() < 0.6:
                cue, e, kind = entity()
                text += cue
                spans.append((len(text), len(text) + len(e), kind))
                text += e + (cue[-1] if cue[-1:] in ("'", '"') else "")
            else:
                text += other()
            text += pick(" ", " ", ", ", ". ") + " ".join(word() for _ in range(rng.integers(1, 5))) + " "
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=2)
def train(sentences: int = 300, seed: int = 5, rounds: int = 40, ridge: float = 0.02) -> Field:
    """Weights of greatest penalised likelihood, by forward-backward sums and Adam."""
    data = []
    for text, spans in _sentences(sentences, seed):
        bounds, segments = candidates(text, 0, len(text))
        place = {b: i for i, b in enumerate(bounds)}
        gold = {(place.get(a), place.get(b)): k for a, b, k in spans}
        of = {s: c for c, s in enumerate(segments)}
        if not all(s in of for s in gold):
            raise ValueError(f"an entity is no candidate: {text!r}, {spans}")
        if not segments:
            continue
        x = np.zeros((len(segments), N_FEATURES))
        for c, (i, j) in enumerate(segments):
            x[c, features(text, bounds[i], bounds[j])] = 1
        i, j = np.array(segments).T
        by_end = {e: np.flatnonzero(j == e) for e in set(j.tolist())}
        by_start = {e: np.flatnonzero(i == e) for e in set(i.tolist())}
        gw, gm = np.zeros((N_FEATURES, len(KINDS))), np.zeros((2, len(KINDS) + 1))
        at, before, starts = 0, 0, {a: (b, k) for (a, b), k in gold.items()}
        while at < len(bounds) - 1:
            if at in starts:
                b, k = starts[at]
                gw[:, k] += x[of[at, b]]
                gm[before, k + 1] += 1
                at, before = b, 1
            else:
                gm[before, 0] += 1
                at, before = at + 1, 0
        data.append((len(bounds) - 1, i, j, by_end, by_start, x, gw, gm))
    w, moves = np.zeros((N_FEATURES, len(KINDS))), np.zeros((2, len(KINDS) + 1))
    w[0] = -2
    m1, m2 = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    for step in range(1, rounds + 1):
        gw, gm = -ridge * w * len(data) / 50, -ridge * moves * len(data) / 50
        for n, i, j, by_end, by_start, x, gold_w, gold_m in data:
            score = x @ w
            fwd, bwd = np.full((n + 1, 2), -np.inf), np.full((n + 1, 2), -np.inf)
            fwd[0, 0] = 0
            enter = np.zeros((len(i), 2, len(KINDS)))
            for e in range(1, n + 1):
                fwd[e, 0] = np.logaddexp(fwd[e - 1, 0] + moves[0, 0], fwd[e - 1, 1] + moves[1, 0])
                if (c := by_end.get(e)) is not None:
                    enter[c] = v = fwd[i[c]][:, :, None] + moves[:, 1:] + score[c][:, None, :]
                    fwd[e, 1] = np.logaddexp.reduce(v.ravel())
            bwd[n] = 0
            total = np.logaddexp(fwd[n, 0], fwd[n, 1])
            for e in range(n - 1, -1, -1):
                bwd[e] = moves[:, 0] + bwd[e + 1, 0]
                if (c := by_start.get(e)) is not None:
                    v = moves[None, :, 1:] + score[c][:, None, :] + bwd[j[c], 1][:, None, None]
                    bwd[e] = np.logaddexp(bwd[e], np.logaddexp.reduce(v.transpose(1, 0, 2).reshape(2, -1), axis=1))
            p = np.exp(enter + bwd[j, 1][:, None, None] - total)
            outside = np.exp(fwd[:-1] + moves[:, 0] + bwd[1:, :1] - total).sum(axis=0)
            gw += gold_w - x.T @ p.sum(axis=1)
            gm += gold_m
            gm[:, 0] -= outside
            gm[:, 1:] -= p.sum(axis=0)
        for k, (param, g) in enumerate(((w, gw / len(data)), (moves, gm / len(data)))):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            param += 0.3 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
    return Field(w, moves)


def find_spans(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the field's are added where they overlap none of the base's."""
    if not text:
        return [], []
    base = base_spans(text)
    out = list(base)
    taken = sorted((a, b) for a, b, _ in base)
    k = 0
    for a, b in windows(text):
        for span in field.decode(text, a, b):
            while k < len(taken) and taken[k][1] <= span[0]:
                k += 1
            if not any(x < span[1] and span[0] < y for x, y in taken[k : k + 8]):
                out.append(span)
    return base, sorted(out, key=lambda s: (s[0], s[2]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def _find(field: Field, redact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = [], []
            for text in batch.column(1).to_pylist():
                base, every = find_spans(text, field)
                own = set(base)
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": (a, b, k) in own} for a, b, k in every])
                if redact:
                    texts.append(mask(text, every))
            columns = [batch.column(0), pa.array(spans, pa.list_(_SPAN))]
            yield pa.record_batch([*columns, pa.array(texts, pa.string())] if redact else columns, names=["row", "spans", "text"][: len(columns) + redact])

    return run


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span (overlapping ones together) replaced by its kind in angle brackets."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b, k in spans:
        if a >= at:
            parts += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


_SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("base", "boolean"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """id, spans (kind, start, end in code points, base: found by the patterns) by start and kind: a row for each row of docs.

    Null and empty texts have none. Ids may be null or repeated; other columns are not read. No shuffle.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_find(field or train(), False), T.StructType([rows.schema["row"]]).add("spans", _SPANS)).withColumnRenamed("row", "id")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", field: Field | None = None) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; chars_col, if there, is the new length of such texts."""
    names = docs.columns
    tune(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    done = packed.mapInArrow(_find(field or train(), True), T.StructType([packed.schema["row"]]).add("spans", _SPANS).add("text", "string"))
    changed = F.size("spans") > 0
    new = {text_col: F.when(changed, F.col("text")).otherwise(F.col("row").getField(text_col))}
    if chars_col in names:
        new[chars_col] = F.when(changed, F.char_length("text").cast(docs.schema[chars_col].dataType)).otherwise(F.col("row").getField(chars_col))
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])


