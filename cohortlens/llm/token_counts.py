"""Token counts by finite-state tokenizer compilation (operator 13).

A byte-level BPE vocabulary is compiled into two deterministic machines:

* the splitter reads classes of characters (letters, digits, white space, the few letters of
  English contractions) and says where a word of the pattern begins.  The character before
  may be needed for that, never more, so its states remember it and a beginning is announced for
  this character or the one before;
* the counter reads the bytes of a word.  Its transitions carry the number of tokens that a byte adds to
  (or, by a merge, takes from) the encoding of what was read.  A state is made of the live
  beginnings of vocabulary entries that end here, the last token before each and its count.
  What follows what is BPE's own rule: a token may follow another if merging the bytes of both gives
  just these two.  States are made when first met and kept for the worker.

A block of texts is cut into stretches of ``STRETCH`` characters that advance side by side.  Every
stretch is first run from each of the splitter's states, which gives its state map; a
parallel prefix scan composes the maps, so that each stretch knows the state it begins in; then
all run once more and announce the words.  Words met before in the worker cost a look-up.

A text over ``CHUNK`` characters is cut anywhere into chunks that spread over the tasks.  A chunk's state map tells,
for every state it may begin in, the state it ends in, the characters before its first word beginning, the
tokens of its closed words and the characters after its last beginning.  Composing two maps counts the word between
them; ``tree_reduce`` composes those of a text over Spark tasks.  Equal long texts are counted once.

Defined results: a null or empty text has 0 tokens and 0 bytes; special strings in a text are tokens of
their own, as in the library's default; rows with null or repeated ids are counted each for itself; an empty table
gives an empty table; other columns are ignored.  A text without any word end (one long run of
letters) is held whole where it is counted, in time linear in its length.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tree_reduce, worker_cache

LIMIT = 1024
CHUNK = 1 << 16
STRETCH = 256
BLOCK = 1 << 19
KEPT_WORDS = KEPT_STATES = 250_000

# ------------------------------------------------------------------------- the splitter

# states: word ended / run of letters, digits, others / "'" alone / "'r" or "'v" / "'l" /
# one space / one other white space / longer white space that ends in a space / in another
END, LETTERS, DIGITS, OTHERS, QUOTE, QUOTE_E, QUOTE_L, SPACE, WHITE, SPACES, WHITES = range(11)
STATES = 11
# classes of characters; STOP ends a text
C_LETTER, C_STMD, C_RV, C_L, C_E, C_DIGIT, C_OTHER, C_QUOTE, C_SPACE, C_WHITE, C_STOP = range(11)
LETTER_CLASSES = (C_LETTER, C_STMD, C_RV, C_L, C_E)
HERE, BEFORE = 1, 2  # a word begins at this character, at the one before it


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, announced beginnings) by state and class."""
    begin = {c: LETTERS for c in LETTER_CLASSES} | {C_DIGIT: DIGITS, C_OTHER: OTHERS, C_QUOTE: QUOTE,
                                                    C_SPACE: SPACE, C_WHITE: WHITE, C_STOP: END}
    run = {c: s for c, s in begin.items()} | {C_QUOTE: OTHERS}
    goes = np.zeros((STATES, 11), np.int8)
    says = np.zeros((STATES, 11), np.int8)
    for c in range(11):
        for s in range(STATES):
            to, say = begin[c], HERE
            white = c in (C_SPACE, C_WHITE)
            if s in (LETTERS, DIGITS, OTHERS) and run[c] == s:
                to, say = s, 0
            elif s == QUOTE and c in (C_OTHER, C_QUOTE):
                to, say = OTHERS, 0
            elif s == QUOTE and c == C_STMD:
                to, say = END, 0
            elif s == QUOTE and c in (C_RV, C_L):
                to, say = (QUOTE_E if c == C_RV else QUOTE_L), 0
            elif (s, c) in ((QUOTE_E, C_E), (QUOTE_L, C_L)):
                to, say = END, 0
            elif s in (QUOTE_E, QUOTE_L):  # no contraction after all: the letter begins a word
                to, say = (LETTERS, BEFORE) if c in LETTER_CLASSES else (begin[c], BEFORE | HERE)
            elif s in (SPACE, WHITE, SPACES, WHITES) and white:
                to, say = (SPACES if c == C_SPACE else WHITES), 0
            elif s == SPACE and c != C_STOP:  # one space goes with the word after it
                to, say = run[c], 0
            elif s == SPACES and c != C_STOP:
                to, say = run[c], BEFORE
            elif s == WHITES and c != C_STOP:
                to, say = begin[c], BEFORE | HERE
            goes[s, c], says[s, c] = to, say
    return goes, says


def class_runs(vocabulary: str) -> list[tuple[int, int]]:
    """(first code point, class) runs of the splitter's classes, asked from the tokenizer itself:
    all code points in a row are cut by it where the class changes."""
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str

    def kind(ch: str) -> int:
        for probe, k in (("a", C_LETTER), ("1", C_DIGIT), ("!", C_OTHER)):
            if len(cut(probe + ch)) == 1:
                return k
        return C_WHITE

    given = {"'": C_QUOTE, " ": C_SPACE, "l": C_L, "e": C_E} | dict.fromkeys("stmd", C_STMD) | dict.fromkeys("rv", C_RV)
    runs = [(c, given.get(chr(c), kind(chr(c)))) for c in range(128)]
    for lo in (c for c in range(0, 0x110000, 4096) if not 0xD800 <= c < 0xE000):
        lo, hi = max(lo, 128), min(lo + 4096, 0xD800) if lo < 0xD800 else lo + 4096
        row = "".join(map(chr, range(lo, hi)))
        for _, (x, y) in cut(row):
            # white space is cut before its last character: each of its characters is asked for itself
            each = range(x, y) if y - x < 64 else [x]
            runs += [(lo + i, kind(row[i])) for i in each]
    return [r for i, r in enumerate(runs) if i == 0 or r[1] != runs[i - 1][1]] + [(0x110000, C_STOP)]


def _class_table(runs: list[tuple[int, int]]) -> np.ndarray:
    first = np.array([r[0] for r in runs] + [0x110001])
    return np.repeat(np.array([r[1] for r in runs], np.int8), np.diff(first))


def announced(machine, classes: np.ndarray, entry: int = END) -> tuple[np.ndarray, int]:
    """(what the splitter says at each character, its last state), begun in ``entry``: state maps of
    stretches, their prefix scan, and a second run from the states found."""
    goes, says = machine
    n = len(classes)
    if n == 0:
        return np.zeros(0, np.int8), entry
    lanes = -(-n // STRETCH)
    grid = np.full(lanes * STRETCH, C_STOP, np.int16)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(lanes, STRETCH).T)
    flat = goes.ravel().astype(np.int16)
    maps = np.broadcast_to(np.arange(STATES, dtype=np.int16), (lanes, STATES)).copy()
    if lanes > 1:
        for row in grid:
            maps = flat[maps * 11 + row[:, None]]
        shift = 1
        while shift < lanes:  # maps[i] becomes the composition of the maps up to i
            maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.int64), axis=1)
            shift *= 2
    state = np.full(lanes, entry, np.int16)
    state[1:] = maps[:-1, entry]
    at = np.empty((STRETCH, lanes), np.int16)
    for k, row in enumerate(grid):
        at[k] = state * 11 + row
        state = flat[at[k]]
    at = at.T.ravel()[:n]
    return says.ravel()[at], int(flat[at[-1]])


def beginnings(said: np.ndarray, before: int = 0) -> np.ndarray:
    """Places of word beginnings, counted from ``before`` characters ahead of the first one read."""
    mark = np.zeros(len(said) + 1, bool)
    mark[1:] = (said & HERE) > 0
    mark[:-1] |= (said & BEFORE) > 0
    return np.flatnonzero(mark) - 1 + before


# ------------------------------------------------------------------------- the counter


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for
    themselves, the others follow from 256 on in order."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in kept}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))})
    return out


class Counter:
    """Transducer from the bytes of a word to its number of tokens, made state by state."""

    def __init__(self, model: dict):
        letters = byte_letters()
        raw = {w: bytes(letters[c] for c in w) for w in model["vocab"]}
        self.rank = {}
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((raw[a], raw[b]), i)
        self.tokens = set(raw.values())
        self.open = {t[:k] for t in self.tokens for k in range(len(t))}
        self.follows = {}
        self.reset()

    def reset(self) -> None:
        self.states = [((b"", None, 0),)]
        self.numbers = {self.states[0]: 0}
        self.arcs = {}  # state and byte in one number -> next state and tokens added in one number

    def merged(self, word: bytes) -> list[bytes]:
        """BPE by definition: the pair of lowest rank, leftmost first, until none is left."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, last: bytes | None, token: bytes) -> bool:
        key = (last, token)
        if key in self.rank:  # these two would be merged themselves
            return False
        if key not in self.follows:
            if len(self.follows) > KEPT_STATES:
                self.follows.clear()
            self.follows[key] = self.merged((last or b"") + token) == [t for t in key if t is not None]
        return self.follows[key]

    def arc(self, state: int, byte: int) -> int:
        """Make the transition of one byte: next state and tokens added, as 512 * state + 256 + added."""
        grown = [(s + bytes([byte]), last, n) for s, last, n in self.states[state]]
        token, added = next((s, n + 1) for s, last, n in grown if s in self.tokens and self.may_follow(last, s))
        key = (*((s, last, n - added) for s, last, n in grown if s in self.open), (b"", token, 0))
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
        found = self.arcs[state << 8 | byte] = self.numbers[key] << 9 | added + 256
        return found

    def count(self, word: bytes) -> int:
        if len(self.states) > KEPT_STATES:
            self.reset()
        state = total = 0
        arcs = self.arcs
        for byte in word:
            found = arcs.get(state << 8 | byte) or self.arc(state, byte)
            state = found >> 9
            total += (found & 511) - 256
        return total


class _Words(dict):
    """Token counts of words met so far."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.count(word.encode())
        if len(word) < 200:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


class Compiled:
    """Both machines of one vocabulary file."""

    def __init__(self, vocabulary: str, runs: list[tuple[int, int]]):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        check_supported(spec)
        self.words = _Words(Counter(spec["model"]))
        self.classes = _class_table(runs)
        self.machine = _splitter()
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text."""
        out = np.zeros(len(texts), np.int64)
        owner, parts = [], []
        for i, t in enumerate(texts):
            cut = self.special.split(t) if self.special else [t]
            out[i] += len(cut) - 1
            owner += [i] * len(cut)
            parts += cut
        if not parts:
            return out
        joined = "\0".join(parts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        stops = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = self.classes[codes]
        classes[stops] = C_STOP
        first = beginnings(announced(self.machine, classes)[0])
        ends = np.append(first[1:], len(joined))
        stop = classes[first] == C_STOP
        words = self.words
        n = [words[joined[x:y]] for x, y in zip(first[~stop].tolist(), ends[~stop].tolist())]
        part = np.searchsorted(stops, first[~stop])
        np.add.at(out, np.array(owner)[part], n)
        return out

    # ---- state maps of chunks

    def state_map(self, chunk: str, before: str, last: bool) -> list:
        """What a chunk does from every state: [end state, open, head, tokens, tail].

        ``before`` is the character ahead of the chunk ('' at a beginning), which belongs to this chunk as
        the chunk's last one belongs to the next: so a word is announced within its chunk.  ``last``: the
        text ends here."""
        own = before + (chunk if last else chunk[:-1])
        classes = self.classes[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)]
        if last:
            classes = np.append(classes, np.int8(C_STOP))
        goes, says = self.machine
        base, base_end = announced(self.machine, classes)
        out = []
        for entry in range(STATES) if before else [END]:
            said, s, t = base.copy(), entry, END
            for i, c in enumerate(classes.tolist()):
                if s == t:  # both runs agree from here on
                    break
                said[i] = says[s, c]
                s, t = goes[s, c], goes[t, c]
            end = base_end if s == t else int(s)
            at = beginnings(said, len(before)).tolist()
            if at:
                n = sum(self.words[own[x:y]] for x, y in zip(at, at[1:]))
                out.append([end, 0, own[:at[0]], n, own[at[-1]:]])
            else:
                out.append([end, 1, own, 0, ""])
        return out

    def compose(self, left: list, right: list) -> list:
        """The map of two successive chunks."""
        out = []
        for end, is_open, head, n, tail in left:
            r_end, r_open, r_head, r_n, r_tail = right[end]
            if is_open and r_open:
                out.append([r_end, 1, head + r_head, 0, ""])
            elif is_open:
                out.append([r_end, 0, head + r_head, r_n, r_tail])
            elif r_open:
                out.append([r_end, 0, head, n, tail + r_head])
            else:
                out.append([r_end, 0, head, n + r_n + self.words[tail + r_head], r_tail])
        return out


def check_supported(spec: dict) -> None:
    """Byte-level BPE with the common splitting pattern and plain special strings; others are an error."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"]
                for t in spec["added_tokens"])
    if (pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or spec.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges") or not plain):
        raise ValueError("only byte-level BPE files without normalizer or leading space can be compiled")


def compiled(vocabulary: str, runs: list[tuple[int, int]]) -> Compiled:
    kept = worker_cache()
    if ("token_counts", vocabulary) not in kept:
        kept["token_counts", vocabulary] = Compiled(vocabulary, runs)
    return kept["token_counts", vocabulary]


# ------------------------------------------------------------------------- jobs


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _blocks(texts: list[str]):
    """Ranges of texts of about ``BLOCK`` characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def _count_short(rows: DataFrame, vocabulary: str, runs: list) -> DataFrame:
    """(id, n_bytes, n_tokens) of texts that fit a chunk."""
    def run(batches):
        tokenizer = compiled(vocabulary, runs)
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            n = [tokenizer.counts(texts[i:j]) for i, j in _blocks(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n) if n else [], pa.int64())],
                                             names=["__id", "n_bytes", "n_tokens"])

    id_type = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {id_type}, n_bytes long, n_tokens long")


def long_text_counts(texts: DataFrame, vocabulary: str, runs: list, chunk: int = CHUNK) -> DataFrame:
    """(key, text) of long texts -> (key, n_tokens): chunks, their state maps and a tree of compositions."""
    def cut(batches):
        special = compiled(vocabulary, runs).special
        for b in batches:
            key, seq, body, before, last, extra = [], [], [], [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = 0
                parts = special.split(text) if special else [text]
                for p, part in enumerate(parts):
                    for x in range(0, max(1, len(part)), chunk):
                        key.append(k)
                        seq.append(at)
                        body.append(part[x:x + chunk])
                        before.append(part[x - 1] if x else "")
                        last.append(x + chunk >= len(part))
                        extra.append(int(last[-1] and p < len(parts) - 1))
                        at += 1
            cols = [pa.array(key, pa.string()), pa.array(seq, pa.int64()), pa.array(body, pa.string()),
                    pa.array(before, pa.string()), pa.array(last, pa.bool_()), pa.array(extra, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "seq", "body", "before", "last", "extra"])

    def maps(batches):
        tokenizer = compiled(vocabulary, runs)
        for b in batches:
            frags = []
            for body, before, last, extra in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
                made = tokenizer.state_map(body, before, last)
                for m in made:
                    m[3] += extra
                frags.append(json.dumps(made).encode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(frags, pa.binary())], names=["key", "seq", "frag"])

    def combine(frags):
        tokenizer = compiled(vocabulary, runs)
        made = json.loads(frags[0])
        for f in frags[1:]:
            made = tokenizer.compose(made, json.loads(f))
        return json.dumps(made).encode()

    chunks = texts.mapInArrow(cut, "key string, seq long, body string, before string, last boolean, extra long")
    # chunks of equal texts are equal: one of them is kept, on the map side already
    chunks = chunks.groupBy("key", "seq").agg(*[F.first(c).alias(c) for c in ("body", "before", "last", "extra")])
    whole = tree_reduce(chunks.mapInArrow(maps, "key string, seq long, frag binary"), combine, name="token-maps")
    return whole.select("key", F.get_json_object(F.col("frag").cast("string"), "$[0][3]").cast("long").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_tokens, over_limit."""
    vocabulary = vocabulary or default_vocabulary()
    runs = class_runs(vocabulary)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text_col).alias("__text"))
    short = _count_short(rows.where(F.coalesce(F.length("__text"), F.lit(0)) <= chunk), vocabulary, runs)
    longer = rows.where(F.length("__text") > chunk).withColumn("key", F.sha2("__text", 256))
    counts = long_text_counts(longer.select("key", "__text"), vocabulary, runs, chunk)
    longer = longer.select("__id", "n_bytes", "key").join(counts, "key").select("__id", "n_bytes", "n_tokens")
    return short.unionByName(longer).select(F.col("__id").alias(id_col), "n_bytes", "n_tokens",
                                            (F.col("n_tokens") > limit).alias("over_limit"))
