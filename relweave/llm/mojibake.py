"""Text that was decoded with the wrong character encoding: found by likelihood, restored where possible.

A character trigram model, smoothed by interpolation with bigrams, single characters and a uniform share, is trained
on the clean records. A token with characters beyond ASCII gets a score as it stands and for what every chain of
encoding and decoding makes of it. A chain either encodes with a single-byte encoding and decodes UTF-8, up to three
times over, or reads the bytes of one single-byte encoding as another. The likeliest candidate is accepted if it gains
more than a margin, in nats. The margin is validated on all tokens of clean records kept from training: what chains make of
them as they stand must stay below it, and how many planted garblings reach it is reported.

Nothing of this depends on more than a token between blanks. So every step works on the different tokens of the corpus
with their counts: they are counted in the JVM, each is scored once, and only the garbled ones are joined with the records
again. A token with characters that are lost (U+FFFD, controls U+0080 to U+009F) and that no chain explains is compared with
what it may have been: all that the characters of the clean records make of it.

A long token, as unspaced scripts have them, is scored in pieces, each by itself and once more with what stands around
it. Pieces end where no chain has a sequence, so that a chain makes of the pieces what it makes of the whole.

Counts are kept in hashed tables of fixed size, so that the model has the same bound for any corpus.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.session import cut, spread

# Python's names of the single-byte encodings that text is commonly mistaken for.
SINGLE = (
    "latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp1258", "cp437", "cp850", "cp852", "cp855", "cp866",
    "koi8-r", "koi8-u", "mac_roman", "mac_cyrillic", "iso8859-2", "iso8859-5", "iso8859-15",
)
#: A record with a UTF-8 sequence under one of these, not of letters alone, is not taken for clean.
USUAL = ("latin-1", "cp1252", "cp1251", "cp437", "cp850", "mac_roman")
STEPS = 3
TRI, BI, UNI = 1 << 20, 1 << 18, 1 << 16
SLOTS = TRI + BI + UNI
#: Shares of trigram, bigram, single character and uniform.
SHARES = (0.62, 0.28, 0.095, 0.005)
ALPHABET = 1 << 17
#: One record in so many is kept from training; all their tokens validate the margin.
HELD_ONE_IN = 20
#: No margin is less, in nats.
LEAST_GAIN = 4.0
#: Longer tokens are scored in pieces of about this length.
LONGEST = 200
#: No sequence of a chain is longer: four bytes, each of which two more steps write with three.
SPAN = 4 * 3 * 3
CACHE = 400_000
BLOCK = 1 << 22

BLANKS, BEYOND = r"[ \t\r\n]+", r"[^\x00-\x7F]"
_SPACE, _SPACES = re.compile(BLANKS), re.compile(f"({BLANKS})")
#: UTF-8 sequences: the ranges of the first byte and of those that follow it.
_SEQUENCES = (
    ((0xC2, 0xDF), (0x80, 0xBF)),
    ((0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)),
    ((0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)),
    ((0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF1, 0xF3), (0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
    ((0xF4, 0xF4), (0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF)),
)
_LOST = re.compile("[�\x80-\x9f]")
_LOST_RUN = re.compile("[�\x80-\x9f]+")
# Signs of ordinary typography that may stand in or around words.
_JOINING = frozenset("–—‘’‚“”„«»‹›…•·°€£§№\u00a0\u00ad")
_DIGITS = str.maketrans("123456789", "000000000")


def _characters(encoding: str) -> list[str]:
    """What each byte stands for; a byte that the encoding leaves open stands for the control of its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class _ToBytes(dict):
    """str.translate table to one character a byte; characters the encoding lacks become U+0000."""

    def __missing__(self, code: int) -> int:
        return code if code < 128 else 0


CHARACTERS = {e: _characters(e) for e in SINGLE}
TO_BYTES = {e: _ToBytes({ord(c): b for b, c in reversed(list(enumerate(cs)))}) for e, cs in CHARACTERS.items()}
REREAD = {(a, b): {ord(x): y for x, y in zip(CHARACTERS[a][128:], CHARACTERS[b][128:])} for a in SINGLE for b in SINGLE if a != b}


def _sequences(encoding: str) -> re.Pattern:
    """What the bytes of a UTF-8 sequence look like in an encoding."""
    bytes_ = TO_BYTES[encoding]
    one = lambda low, high: "[" + "".join(re.escape(chr(c)) for c, b in bytes_.items() if low <= b <= high) + "]"
    return re.compile("|".join("".join(one(*r) for r in sequence) for sequence in _SEQUENCES))


UTF8_IN = {e: _sequences(e) for e in SINGLE}
#: Whether any of them can match.
_ANY_UTF8 = re.compile("|".join(dict.fromkeys(p.pattern for p in UTF8_IN.values())))


def decode_utf8(s: str, encoding: str) -> str:
    """``s`` with each valid UTF-8 sequence among its bytes in ``encoding`` replaced by the character it encodes."""
    table = TO_BYTES[encoding]
    return UTF8_IN[encoding].sub(lambda m: m.group().translate(table).encode("latin-1").decode("utf-8"), s)


#: Characters beyond ASCII that some encoding has; next to others, and to ASCII, no sequence can go on.
CONVERTIBLE = frozenset(c for cs in CHARACTERS.values() for c in cs if c > "\x7f")


def applied(chain: str, s: str) -> str:
    """What a chain, by its name, makes of ``s``."""
    for step in chain.split():
        a, b = step.split(">")
        s = decode_utf8(s, a) if b == "utf-8" else s.translate(REREAD[a, b])
    return s


def _inside(s: str) -> bytearray:
    """For each position of ``s``, whether a cut before it would split a sequence of some chain."""
    inside, now, known = bytearray(len(s) + 1), {s: list(range(len(s) + 1))}, {s}
    for _ in range(STEPS):
        after = {}
        for t, starts in now.items():
            for e in SINGLE:
                out, kept, at = [], [], 0
                for m in UTF8_IN[e].finditer(t):
                    i, j = m.span()
                    for p in range(starts[i] + 1, starts[j]):
                        inside[p] = 1
                    out += [t[at:i], decode_utf8(m.group(), e)]
                    kept += starts[at : i + 1]
                    at = j
                u = "".join(out) + t[at:]
                if at and u not in known:
                    known.add(u)
                    after[u] = kept + starts[at:]
        now = after
    return inside


def _cut(token: str, at: int, back: int) -> int:
    """The last position of the ``back`` up to ``at`` where no sequence is split, else one after ``at``; at worst the end."""
    for p in range(at, at - back, -1):
        if token[p - 1] not in CONVERTIBLE or token[p] not in CONVERTIBLE:
            return p
    low, high = at - back, at
    while low < len(token):
        first = max(0, low - SPAN)
        inside = _inside(token[first : high + SPAN])
        for p in range(high, low, -1):
            if not inside[p - first]:
                return p
        low, high = high, min(len(token), high + LONGEST)
    return len(token)


def pieces(token: str) -> list[tuple[str, str]]:
    """The consecutive pieces of a token, each with what it is scored in: the piece and about a quarter of its length on
    either side. A token of usual length is one piece."""
    if len(token) <= LONGEST:
        return [(token, token)]
    # four cells a piece; a piece is seen with the cell before and the cell after it
    n, cuts = 4 * -(-len(token) // LONGEST), [0]
    for k in range(1, n):
        at = k * len(token) // n
        if at > cuts[-1]:
            cuts.append(_cut(token, at, min(at - cuts[-1], LONGEST // 8)))
    cuts = [c for c in cuts if c < len(token)] + [len(token)]
    return [(token[cuts[k] : cuts[min(k + 4, len(cuts) - 1)]], token[cuts[max(k - 1, 0)] : cuts[min(k + 5, len(cuts) - 1)]]) for k in range(0, len(cuts) - 1, 4)]


class Chains:
    """The chains that end in characters which the clean records have; what ends in others cannot be likely."""

    def __init__(self, seen=lambda c: True):
        self.seen = seen
        self.reread = []
        for (a, b), to in REREAD.items():
            kept = {x: y for x, y in to.items() if not "\x80" <= y <= "\x9f" and seen(y)}
            if any(chr(x) != y for x, y in kept.items()):
                self.reread.append((f"{a}>{b}", kept, kept.keys()))
        # by the characters beyond ASCII of a string: what rereading makes of them, each outcome once
        self.outcomes: dict[frozenset[int], list[tuple[str, dict[int, str]]]] = {}

    def __call__(self, s: str, reread: bool = True) -> dict[str, str]:
        """Every string that a chain makes of ``s``, with the first such chain; ``reread`` asks for single-byte chains too."""
        out: dict[str, str] = {}
        now, known = {s: ""}, {s}
        for _ in range(STEPS):
            after = {}
            for t, chain in now.items():
                if t.isascii() or not _ANY_UTF8.search(t):
                    continue
                for e in SINGLE:
                    u = decode_utf8(t, e)
                    if u not in known:
                        known.add(u)
                        after[u] = f"{chain}{e}>utf-8 "
                        if not _LOST.search(u) and all(c < "\x80" or self.seen(c) for c in u):
                            out[u] = after[u].strip()
            now = after
        if reread:
            own = frozenset(ord(c) for c in s if c > "\x7f")
            if own not in self.outcomes:
                if len(self.outcomes) > CACHE:
                    self.outcomes.clear()
                made = {}
                for name, to, characters in self.reread:
                    if own <= characters:
                        table = {c: to[c] for c in own}
                        if any(chr(c) != y for c, y in table.items()):
                            made.setdefault(tuple(sorted(table.items())), (name, table))
                self.outcomes[own] = list(made.values())
            for name, table in self.outcomes[own]:
                out.setdefault(s.translate(table), name)
        return out


def _prior(chain: str) -> float:
    """Every chain of a kind is as likely as the others: the log of one over their number."""
    steps = chain.split()
    return -math.log(len(SINGLE)) * len(steps) if steps[0].endswith(">utf-8") else -math.log(len(REREAD))


def _hashed(key: np.ndarray, size: int) -> np.ndarray:
    h = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(size - 1)).astype("i8")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")


def _slots(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of trigrams, of their first two, of their last two and of their last characters, by the last's position."""
    x, y, z = c[:-2], c[1:-1], c[2:]
    return _hashed((x << np.uint64(42)) | (y << np.uint64(21)) | z, TRI), _hashed((x << np.uint64(21)) | y, BI), _hashed((y << np.uint64(21)) | z, BI), _hashed(z, UNI)


def _spaced(text: str) -> str:
    """Two blanks before and after each token, so that tokens are scored on their own; digits are alike."""
    return "  " + _SPACE.sub("  ", text).translate(_DIGITS) + "  "


@dataclass
class Model:
    tri: np.ndarray
    bi: np.ndarray
    uni: np.ndarray

    def __getstate__(self) -> dict:
        return {"tri": self.tri, "bi": self.bi, "uni": self.uni}

    @cached_property
    def chains(self) -> Chains:
        known: dict[str, bool] = {}

        def seen(c: str) -> bool:
            if c not in known:
                known[c] = bool(self.uni[_hashed(_codes(c), UNI)[0]] > 0)
            return known[c]

        return Chains(seen)

    def per_character(self, text: str) -> np.ndarray:
        c = _codes(text)
        tri, first, last, one = _slots(c)
        mid = _hashed(c[1:-1], UNI)
        a, b, u, v = SHARES
        # a pair is no more frequent than its characters, a triple no more than its pairs: this undoes most collisions
        pair = np.minimum(self.bi[last], np.minimum(self.uni[mid], self.uni[one]))
        triple = np.minimum(self.tri[tri], np.minimum(self.bi[first], pair))
        p = a * triple / np.maximum(self.bi[first], 1) + b * pair / np.maximum(self.uni[mid], 1) + u * self.uni[one] / max(1.0, float(self.uni.sum())) + v / ALPHABET
        return np.log(p)

    def scores(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token, with the blanks that end it: its log-likelihood, how much of it (as a positive number) lies at
        characters beyond ASCII and the two after each, where a chain can change it, and how many characters these are."""
        if not tokens:
            return np.empty(0), np.empty(0), np.empty(0)
        # words in capitals are rare, so they are scored as what they are in small letters
        tokens = [t.lower() if len(t) > 2 and t.isupper() and sum(map(str.isalpha, t)) > 2 and len(t.lower()) == len(t) else t for t in tokens]
        text = "  " + "".join(t.translate(_DIGITS) + "  " for t in tokens)
        logs = self.per_character(text)
        beyond = _codes(text) > 127
        open_ = beyond[2:] | beyond[1:-1] | beyond[:-2]
        ends = np.cumsum([len(t) + 2 for t in tokens])
        starts = np.r_[0, ends[:-1]]
        return np.add.reduceat(logs, starts), np.add.reduceat(np.where(open_, -logs, 0), starts), np.add.reduceat(open_.astype("i8"), starts)


    def lost_gain(self, token: str) -> float:
        """How much likelier than the token is that its lost characters stand for others: over all characters that a run of
        them may have been, and less the prior of a garbling."""
        others = [c for c in sorted(CONVERTIBLE) if not _LOST.search(c) and self.chains.seen(c)] + [chr(k) for k in range(33, 127)]
        made = [_LOST_RUN.sub(lambda _, c=c: c, token) for c in others]
        scores, _, _ = self.scores(made + [token])
        return float(np.logaddexp.reduce(scores[:-1]) - scores[-1] - math.log(len(SINGLE)))


@cache
def _kind(c: str) -> tuple[str | None, bool, bool, bool] | None:
    """The alphabet of a letter, whether it is a Latin one beyond ASCII, upper case, lower case; without an alphabet a sign
    that may stand in words; None for any other."""
    if c.isascii() and not c.isalpha() or c in _JOINING:
        return None, False, False, False
    if not c.isalpha():
        return None
    latin = c.isascii() or unicodedata.name(c, "").startswith("LATIN")
    return "LATIN" if latin else unicodedata.name(c, "?").split()[0], latin and not c.isascii(), c.isupper(), c.islower()


def _plain_token(token: str) -> bool:
    """Letters of one alphabet, no sign but ASCII and joining punctuation, no lower case letter before an upper case one, and
    at most three letters beyond ASCII in a row in the Latin alphabet."""
    alphabet, row, lower = None, 0, False
    for c in token:
        kind = _kind(c)
        if kind is None:
            return False
        own, beyond, upper, small = kind
        if own is None:
            row, lower = 0, False
            continue
        row = row + 1 if beyond else 0
        if row > 3 or lower and upper or alphabet not in (None, own):
            return False
        alphabet, lower = own, small
    return True


def looks_clean(text: str) -> bool:
    """No lost or control character, no UTF-8 sequence with a sign in it under a usual encoding, and none but plain tokens."""
    if text.isascii():
        return True
    if _LOST.search(text):
        return False
    for e in USUAL if _ANY_UTF8.search(text) else ():
        if any(not m.group().isalpha() for m in UTF8_IN[e].finditer(text)):
            return False
    return all(_plain_token(t) for t in _SPACE.split(text) if not t.isascii())


def _clean_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (doc_id, held, text) beyond ASCII to (doc_id, held, tokens, n) of the clean ones, digits alike: the tokens beyond
    ASCII record by record, the others for all records together, with a null doc_id."""
    plain: dict[str, bool] = {}
    for batch in batches:
        docs, helds, lists, ns, ascii_ = [], [], [], [], ({}, {})
        for doc, held, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            tokens, own, clean = _SPACE.split(text), {}, True
            for t in tokens:
                if not t.isascii():
                    if t not in plain:
                        if len(plain) > CACHE:
                            plain.clear()
                        plain[t] = looks_clean(t)
                    if not plain[t]:
                        clean = False
                        break
                    own[t] = own.get(t, 0) + 1
            if clean:
                docs.append(doc)
                helds.append(held)
                lists.append([t.translate(_DIGITS) for t in own])
                ns.append(list(own.values()))
                count = ascii_[held]
                for t in tokens:
                    if t.isascii():
                        count[t] = count.get(t, 0) + 1
        for held, own in enumerate(ascii_):
            docs.append(None)
            helds.append(held)
            lists.append([t.translate(_DIGITS) for t in own])
            ns.append(list(own.values()))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(helds, pa.int32()), pa.array(lists, pa.list_(pa.string())), pa.array(ns, pa.list_(pa.int64()))], ["doc_id", "held", "tokens", "n"])


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token", "held").agg(F.sum("n").alias("n"))


def clean_tokens(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tokens of the clean records (doc_id, text): those beyond ASCII as (doc_id, held, token, n), the others counted as
    (token, held, n). One record in ``HELD_ONE_IN`` is held out. Digits are alike. Records of ASCII characters are clean
    and stay in the JVM."""
    rows = rows.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HELD_ONE_IN)) == 0).cast("int").alias("held"), "text")
    beyond = cut(rows.filter(F.col("text").rlike(BEYOND)).mapInArrow(_clean_tokens, "doc_id bigint, held int, tokens array<string>, n array<bigint>"))
    beyond = beyond.select("doc_id", "held", F.explode(F.arrays_zip("tokens", "n")).alias("e")).select("doc_id", "held", F.col("e.tokens").alias("token"), "e.n")
    digits = F.translate("text", "123456789", "000000000")
    plain = rows.filter(~F.col("text").rlike(BEYOND)).select(F.explode(F.split(digits, BLANKS)).alias("token"), "held", F.lit(1).cast("bigint").alias("n")).filter("token <> ''")
    return beyond.filter("doc_id IS NOT NULL"), cut(_counted(plain.unionByName(beyond.filter("doc_id IS NULL AND token <> ''").select("token", "held", "n"))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # of the records to train on, and of those held out
    totals = np.zeros((2, SLOTS))
    for batch in batches:
        tokens, held, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        sizes = np.array([len(t) + 2 for t in tokens])
        for out, total in enumerate(totals):
            mine = np.flatnonzero(held == out)
            for some in np.split(mine, np.flatnonzero(np.diff(np.cumsum(sizes[mine]) // BLOCK)) + 1) if len(mine) else ():
                # two blanks before and after each token, so that tokens count on their own
                tri, _, last, one = _slots(_codes("  " + "".join(tokens[k] + "  " for k in some)))
                weights = np.repeat(n[some], sizes[some]).astype("f8")
                for slots, at, size in ((tri, 0, TRI), (last, TRI, BI), (one, TRI + BI, UNI)):
                    total[at : at + size] += np.bincount(slots, weights, minlength=size)
    at = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(np.rint(totals.ravel()[at]).astype("i8"))], ["slot", "n"])


def train(counted: DataFrame) -> tuple[Model, Model]:
    """The model of counted tokens (token, held, n) without the records held out, and that of all; at most ``2 * SLOTS`` rows
    reach the driver."""
    rows = counted.mapInArrow(_counts, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(2 * SLOTS)
    totals[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    kept, held = totals[:SLOTS], totals[SLOTS:]
    return tuple(Model(*np.split(t.astype("f4"), [TRI, TRI + BI])) for t in (kept, kept + held))


def garbled(token: str, rng: random.Random) -> str | None:
    """The token after a garbling drawn at random, or None if its characters do not allow it."""
    try:
        if rng.random() < 0.75:
            e = rng.choice(("latin-1", "cp1252", "cp1251", "cp437", "cp850", "mac_roman"))
            for _ in range(rng.choice((1, 1, 1, 2))):
                token = "".join(CHARACTERS[e][b] for b in token.encode("utf-8"))
            return token
        a, b = rng.choice((("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1250", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("mac_roman", "latin-1")))
        return token.encode(a).decode(b)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


@dataclass(frozen=True)
class Margin:
    """What a candidate must gain, and the likelihood of a character, as a positive number, that none does better than.

    ``false_positives`` and ``recall`` are shares of the held-out tokens, as they stand and garbled.
    """

    gain: float
    best: float
    false_positives: float
    recall: float


def best_candidates(model: Model, tokens: list[str], margin: Margin | None = None) -> list[tuple[str, str, float]]:
    """For each token its likeliest candidate, the chain and the gain in log-likelihood less the chain's prior;
    ('', '', -inf) if no chain applies.

    A chain changes the likelihood only where characters beyond ASCII stand. If what the token loses there, less the
    least that as many characters cost and the prior, is not above the margin, no candidate is made.
    """
    own, at_stake, n = model.scores(tokens)
    if margin:
        decode = at_stake - margin.best * n / 4 - math.log(len(SINGLE)) > margin.gain
        reread = at_stake - margin.best * n - math.log(len(REREAD)) > margin.gain
    else:
        decode = reread = np.ones(len(tokens), bool)
    out, made, flat = [], [], []
    for t, d, r in zip(tokens, decode, reread):
        made.append(model.chains(t, bool(r)) if d else {})
        flat += made[-1]
    scores, _, _ = model.scores(flat)
    at = 0
    for c, s in zip(made, own):
        if not c:
            out.append(("", "", float("-inf")))
            continue
        part = scores[at : at + len(c)] + np.array([_prior(chain) for chain in c.values()])
        k = int(part.argmax())
        u = flat[at + k]
        at += len(c)
        out.append((u, c[u], float(part[k] - s)))
    return out


def _stakes(shipped):
    """Tokens, the long ones in pieces, to (token, stake): what a character costs where a chain can change it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [p for t in batch.column(0).to_pylist() for p, _ in pieces(t) if not p.isascii()]
            _, at_stake, n = shipped.value.scores(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(at_stake / np.maximum(n, 1), pa.float64())], ["token", "stake"])

    return run


def _gains(shipped, seed: int, planted: bool):
    """Tokens to (clean, dirty): what they gain as they stand and garbled, -inf below ``LEAST_GAIN`` at best; ``dirty`` is null
    where a token cannot be garbled as drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, margin = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                tokens = batch.column(0).slice(at, 500).to_pylist()
                clean = [g for _, _, g in best_candidates(model, tokens, margin)]
                dirty: list[float | None] = [None] * len(tokens)
                if planted:
                    drawn = [(k, g) for k, t in enumerate(tokens) if (g := garbled(t, random.Random(f"{seed}-{t}"))) and g != t]
                    for (k, _), (_, _, gain) in zip(drawn, best_candidates(model, [g for _, g in drawn], margin)):
                        dirty[k] = gain
                yield pa.RecordBatch.from_arrays([pa.array(clean, pa.float64()), pa.array(dirty, pa.float64())], ["clean", "dirty"])

    return run


def validate(model: Model, tokens: DataFrame | list, seed: int = 8, planted: bool = True) -> Margin:
    """The margin that 999 of 1000 clean tokens (token) stay below, 4 nats at least; ``recall`` is the share of garbled ones above it.

    Every token counts. They are scored in tasks, and only counts and single values reach the driver. ``planted`` asks for the recall.
    """
    if not tokens:
        return Margin(8.0, 0.5, 0.0, 0.0)
    context = tokens.sparkSession.sparkContext
    stakes = cut(_dealt(tokens).mapInArrow(_stakes(context.broadcast(model)), "token string, stake double"))
    n = stakes.count()
    if not n:
        return Margin(8.0, 0.5, 0.0, 0.0)
    best = stakes.select("stake").orderBy("stake").limit(1 + n // 500).agg(F.max("stake")).first()[0]
    shipped = context.broadcast((model, Margin(LEAST_GAIN, best, 0.0, 0.0)))
    gains = cut(_dealt(stakes.select("token")).mapInArrow(_gains(shipped, seed, planted), "clean double, dirty double"))
    gain = max(LEAST_GAIN, gains.select("clean").orderBy(F.desc("clean")).limit(1 + n // 1000).agg(F.min("clean")).first()[0])
    false, found = gains.agg(F.avg((F.col("clean") > gain).cast("double")), F.avg((F.col("dirty") > gain).cast("double"))).first()
    return Margin(gain, best, false, found or 0.0)


#: What the worker has found out about tokens, by model; workers outlive the tasks that use them.
_KNOWN: dict[str, dict] = {}


class Restorer:
    """Texts to (garbled, restored text or None, chains), with a bounded memory of tokens that later tasks share."""

    def __init__(self, model: Model, margin: Margin):
        self.model, self.margin = model, margin
        name = f"{margin}{float(model.tri.sum())}{float(model.uni.max())}"
        if name not in _KNOWN:
            while len(_KNOWN) > 1:
                _KNOWN.pop(next(iter(_KNOWN)))
            _KNOWN[name] = {}
        self.known = _KNOWN[name]
        self.pieces: dict[str, list[tuple[str, str]]] = {}

    def learn(self, texts: list[str | None]) -> None:
        words = {t for text in texts if text and not text.isascii() for t in _SPACE.split(text) if not t.isascii()}
        self.pieces = {t: pieces(t) for t in words if len(t) > LONGEST}
        tokens = words - self.pieces.keys()
        tokens.update(s for ps in self.pieces.values() for both in ps for s in both if not s.isascii())
        if len(self.known) > CACHE:
            self.known.clear()
        new = [t for t in tokens if t not in self.known]
        for at in range(0, len(new), 500):
            part = new[at : at + 500]
            for t, (u, chain, gain) in zip(part, best_candidates(self.model, part, self.margin)):
                self.known[t] = (u, chain) if gain > self.margin.gain else None

    def __call__(self, text: str | None) -> tuple[bool, str | None, str | None]:
        if not text or text.isascii():
            return False, None, None
        chains: set[str] = set()

        def restored(piece: str, around: str) -> str:
            got = self.known.get(piece)
            if not got and around != piece and (wide := self.known.get(around)):
                # what the surroundings give away, if it is found in the piece as well
                u = applied(wide[1], piece)
                got = (u, wide[1]) if u != piece else None
            if not got:
                return piece
            chains.add(got[1])
            return got[0]

        parts = [t if t.isascii() else "".join(restored(*p) for p in self.pieces.get(t) or pieces(t)) for t in _SPACES.split(text)]
        out = "".join(parts)
        lost = [p for t in parts if _LOST.search(t) for p, _ in pieces(t) if _LOST.search(p)]
        if not chains and not any(self.model.lost_gain(p) > self.margin.gain for p in lost):
            return False, None, None
        return True, out if chains and not lost else None, ", ".join(sorted(chains)) or None


def _scored(shipped):
    """Tokens to those that are garbled: (token, restored, chains)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                tokens = batch.column(0).slice(at, 2000).to_pylist()
                restorer.learn(tokens)
                rows = [(t, *r[1:]) for t in tokens if (r := restorer(t))[0]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["token", "restored", "chains"])

    return run


def _dealt(tokens: DataFrame) -> DataFrame:
    """A token costs much more to score than to move, so the tokens are dealt to many tasks, which adaptive execution does not
    merge."""
    spark = tokens.sparkSession
    return tokens.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "token")


def garbled_tokens(tokens: DataFrame, fitted: tuple[Model, Margin]) -> DataFrame:
    """(token, restored, chains) of the garbled ones among different tokens beyond ASCII, as a table."""
    shipped = tokens.sparkSession.sparkContext.broadcast(fitted)  # two models of SLOTS numbers
    return cut(_dealt(tokens).mapInArrow(_scored(shipped), "token string, restored string, chains string"))


def _rows(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


def _tokens(rows: DataFrame) -> DataFrame:
    """(doc_id, token): the different tokens beyond ASCII of each record."""
    beyond = F.filter(F.split("text", BLANKS), lambda t: t.rlike(BEYOND))
    return rows.filter(F.col("text").rlike(BEYOND)).select("doc_id", F.explode(F.array_distinct(beyond)).alias("token"))


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Model, Margin]:
    """Train on all clean records, once more without the tokens beyond ASCII of records in which the first model finds garbled ones.

    The margin is validated on all tokens beyond ASCII of the held-out records, with the counts that leave these out; the model
    given out has them too.
    """
    beyond, plain = clean_tokens(spread(_rows(documents, doc_id, text)))
    counted = cut(_counted(beyond))
    tokens = counted.filter("held = 1").select("token")
    part, _ = train(plain.unionByName(counted))
    doubted = garbled_tokens(counted.select("token").distinct(), (part, validate(part, tokens, planted=False)))
    records = beyond.join(doubted.select("token"), "token", "left_semi").select("doc_id").distinct()
    part, whole = train(plain.unionByName(_counted(beyond.join(records, "doc_id", "left_anti"))))
    return whole, validate(part, tokens)


def _found(documents: DataFrame, doc_id: str, text: str, fitted: tuple[Model, Margin] | None) -> tuple[DataFrame, DataFrame]:
    """The records (doc_id, text), and (doc_id, token, restored, chains) of their garbled tokens."""
    rows = _rows(documents, doc_id, text)
    tokens = _tokens(rows)
    bad = garbled_tokens(tokens.select("token").distinct(), fitted or fit(documents, doc_id, text))
    return rows, tokens.join(bad, "token")


def found_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", fitted: tuple[Model, Margin] | None = None) -> DataFrame:
    """(doc_id) of every garbled document."""
    return _found(documents, doc_id, text, fitted)[1].select("doc_id").distinct()


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, chains = [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            known = {f["token"]: f["restored"] for f in found}
            used = {c for f in found if f["chains"] for c in f["chains"].split(", ")}
            out = "".join(known.get(t) or t for t in _SPACES.split(text))
            texts.append(None if _LOST.search(out) or None in known.values() else out)
            chains.append(", ".join(sorted(used)) or None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(chains, pa.string())], ["doc_id", "restored", "chains"])


def garbled_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", fitted: tuple[Model, Margin] | None = None) -> DataFrame:
    """(doc_id, restored, chains) of every garbled document.

    ``restored`` is the whole text with the accepted candidates in place, or null if characters are lost for good (U+FFFD,
    or control characters U+0080 to U+009F that no chain explains). Null, empty and ASCII texts are never garbled.
    Other columns are dropped.
    """
    rows, tokens = _found(documents, doc_id, text, fitted)
    found = tokens.groupBy("doc_id").agg(F.collect_list(F.struct("token", "restored", "chains")).alias("found"))  # as long as the text
    return rows.join(found, "doc_id").mapInArrow(_put_together, "doc_id bigint, restored string, chains string")
