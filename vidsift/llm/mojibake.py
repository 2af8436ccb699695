"""Texts decoded with the wrong encoding: mappings inferred from clean near-twins by alignment, then applied to all records."""

from __future__ import annotations

import hashlib
import importlib
import pkgutil
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vidsift.session import cut, spread

TONES = "̣̀́̃̉"
REPLACED = "�"
#: Where alignments can't tell single-byte encodings apart, these come first.
COMMON = ("cp1252", "iso8859_1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")

#: ASCII letters that the stripped words of a context must hold.
LEAST_LETTERS = 4
#: Contexts that must show a mapping, beyond those that better supported mappings explain.
LEAST_SUPPORT = 3
#: Share of the weight of an inferred mapping on which a public encoding must agree to complete it.
AGREEMENT = 0.9
#: Assignments that a mapping needs: to be completed by a public encoding; to stand without one; to be letters read as other letters.
LEAST_ASSIGNMENTS, OWN_ASSIGNMENTS, LETTER_ASSIGNMENTS = 4, 16, 6
#: Assignments in which a mapping must differ from each better supported one; fewer come from wrong twins of known damage.
DIFFERENT = 3
#: A sequence that is the only evidence in this share of its documents, or more, is taken for ordinary text.
ALONE_SHARE = 0.6
#: Characters that a task looks through at a time.
PIECE_CHARS = 2_000_000

Node = tuple[int, int]


@lru_cache(maxsize=None)
def encodings() -> dict[str, str]:
    """All single-byte encodings of the standard library that hold ASCII: 256 characters each; an undefined one is the control
    character of its number."""
    import encodings as library

    out = {}
    names = sorted(m.name for m in pkgutil.iter_modules(library.__path__))
    for name in sorted(names, key=lambda n: (COMMON.index(n) if n in COMMON else len(COMMON), n)):
        table = getattr(importlib.import_module(f"encodings.{name}"), "decoding_table", None) if name.startswith(("cp", "iso8859", "koi8", "mac", "tis", "kz", "ptcp", "hp")) else None
        if table and len(table) == 256 and table[32:127] == "".join(map(chr, range(32, 127))):
            out[name] = "".join(chr(b) if c in ("￾", REPLACED) else c for b, c in enumerate(table))
    return out


def tones_apart(s: str) -> str:
    """Vietnamese letters with their tone mark as a character of its own; all else composed."""
    out = []
    for c in unicodedata.normalize("NFC", s):
        d = unicodedata.normalize("NFD", c)
        tone = "".join(m for m in d[1:] if m in TONES)
        out.append(unicodedata.normalize("NFC", "".join(m for m in d if m not in TONES)) + tone if tone else c)
    return "".join(out)


def misread(clean: str, t: tuple[str, str]) -> str | None:
    """What a clean text looks like after it was written with t[0] and read with t[1], a single-byte encoding; null if it can't be written so."""
    written, read = t
    table = encodings()[read]
    try:
        data = (tones_apart(clean) if written == "cp1258" else clean).encode(written)
    except UnicodeEncodeError:
        return None
    return "".join(table[b] for b in data)


_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def stripped(s: str) -> str:
    return _NON_ASCII.sub("", s)


def _stretches(s: str) -> list[str]:
    """The non-ASCII characters before, between and after the ASCII characters."""
    out, own = [], ""
    for c in s:
        if c < "\x80":
            out.append(own)
            own = ""
        else:
            own += c
    return [*out, own]


def assignments(form: str, clean: str) -> tuple[int, list[Node]] | None:
    """What the characters of a word stand for, if its clean twin explains them: the stretches between the same ASCII characters
    face each other. Kind 0: each character of the form is a byte of the clean UTF-8 text (byte, character), and no clean
    letter is left; kind 1: each stands for one clean letter (letter, character), two different ones at least. Null if
    neither holds throughout.
    """
    pairs = [(x, y) for x, y in zip(_stretches(form), _stretches(clean)) if x != y]
    if not pairs or stripped(form) != stripped(clean):
        return None
    for kind in (0, 1):
        own: dict[int, int] = {}
        for x, y in pairs:
            source = y.encode() if kind == 0 else list(map(ord, y))
            if len(source) != len(x) or (kind == 0 and set(x) & set(y)) or any(own.setdefault(s, ord(c)) != ord(c) for s, c in zip(source, x) if kind == 0 or s != ord(c)):
                break
        else:
            if kind == 0 or len(own) > 1:
                return kind, sorted((s, c) for s, c in own.items() if chr(c) != REPLACED)
    return None


class _Vocabulary:
    """What a task knows about words: the hash of their ASCII characters and the number of letters among these, as stored and
    with tones apart, and their form with tones apart."""

    def __init__(self) -> None:
        self.known: dict[str, tuple] = {}

    @staticmethod
    def _hash(s: str) -> int:
        return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little")

    def look(self, words: list[str]) -> tuple[np.ndarray, ...]:
        if len(self.known) > 500_000:
            self.known.clear()
        out = []
        for w in words:
            got = self.known.get(w)
            if got is None:
                if w.isascii():
                    h, n = self._hash(w), sum(map(str.isalpha, w))
                    got = (h, n, h, n, w, False)
                else:
                    apart = tones_apart(w)
                    a, b = stripped(w), stripped(apart)
                    got = (self._hash(a), sum(map(str.isalpha, a)), self._hash(b), sum(map(str.isalpha, b)), apart, True)
                self.known[w] = got
            out.append(got)
        h, n, h1, n1, apart, odd = zip(*out)
        return np.array(h, np.uint64), np.array(n), np.array(h1, np.uint64), np.array(n1), np.array(apart, object), np.array(odd)


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with non-ASCII characters in their contexts, counted within the batch, and the non-ASCII characters themselves.

    A context is a word between its neighbours, all stripped of non-ASCII characters: key, word, kind, n. kind 0: as
    stored; 1: with tone marks apart, so that stripping leaves the letter below them; 2: a character (key) and how often it occurs.
    """
    vocabulary = _Vocabulary()
    for batch in batches:
        lists = pc.ascii_split_whitespace(batch.column(0))
        flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        coded = flat.filter(pa.array(full)).dictionary_encode()
        ids, parent, words = coded.indices.to_numpy(zero_copy_only=False), parent[full], coded.dictionary.to_pylist()
        if len(ids) == 0:
            continue
        h, n, h1, n1, apart, odd = vocabulary.look(words)
        changed = np.array([a != w for a, w in zip(apart, words)])
        times = np.bincount(ids, minlength=len(words))
        chars: dict[str, int] = defaultdict(int)
        for w, t in zip(np.array(words, object)[odd], times[odd].tolist()):
            for c in w:
                if c >= "\x80":
                    chars[c] += t
        at = np.flatnonzero(odd[ids])
        at = at[(at > 0) & (at < len(ids) - 1)]
        at = at[(parent[at - 1] == parent[at]) & (parent[at + 1] == parent[at])]
        own = [ids[at - 1], ids[at], ids[at + 1]]

        def rows(hashes: np.ndarray, letters: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, ...]:
            keep = keep & (sum(letters[x] for x in own) >= LEAST_LETTERS)
            with np.errstate(over="ignore"):
                key = sum((hashes[x][keep] * m for x, m in zip(own, _MIX)), np.uint64(0))
            t = pa.table({"key": key.view(np.int64), "w": own[1][keep]}).group_by(["key", "w"]).aggregate([([], "count_all")])
            return t["key"].to_numpy(), t["w"].to_numpy(), t["count_all"].to_numpy()

        k0, w0, c0 = rows(h, n, np.ones(len(at), bool))
        k1, w1, c1 = rows(h1, n1, changed[own[0]] | changed[own[1]] | changed[own[2]])
        forms = np.concatenate([np.array(words, object)[w0], apart[w1], np.full(len(chars), "", object)])
        kinds = np.repeat(np.array([0, 1, 2], np.int32), [len(k0), len(k1), len(chars)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([k0, k1, np.array(list(map(ord, chars)), np.int64)])), pa.array(forms, pa.string()), pa.array(kinds), pa.array(np.concatenate([c0, c1, np.array(list(chars.values()), np.int64)]))],
            ["key", "word", "kind", "n"],
        )


_LINKS = "kind int, s int, c int, s2 int, c2 int, n long"


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a word and its clean twin to the pairs of assignments that they show together; characters pass through as kind 2."""
    for batch in batches:
        out: dict[tuple, int] = defaultdict(int)
        for word, twin, n, char in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if twin is None:
                out[2, char, 0, 0, 0] += n
            elif (found := assignments(word, twin)) is not None:
                for (s, c), (s2, c2) in combinations(found[1], 2):
                    out[found[0], s, c, s2, c2] += n
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int32()) for x in cols], pa.array(list(out.values()), pa.int64())], ["kind", "s", "c", "s2", "c2", "n"])


def tables(links: dict[tuple[Node, Node], int], least: int = LEAST_SUPPORT) -> list[dict[int, tuple[int, int]]]:
    """Mappings (source to character and weight) that the links between assignments form, the best supported first.

    A mapping begins with the strongest link that none before it explains and takes in, one after another, the assignment
    that the most members are linked with. Where members have rivals (other characters for the same source), an assignment
    that is mostly linked with the rivals alone belongs to another mapping; one linked with both may belong to both. No
    two sources share a character. A
    mapping that hardly differs from one before it is dropped.
    """
    near: dict[Node, dict[Node, int]] = defaultdict(dict)
    for (a, b), n in links.items():
        near[a][b] = near[b][a] = n
    left, out = dict(links), []
    while left:
        seed = max(left, key=lambda e: (left[e], e))
        if left[seed] < least:
            break
        table: dict[int, int] = dict(seed)
        while True:
            best, mark = None, (0, 0, (0, 0))
            for node in {m for s, c in table.items() for m in near[s, c]}:
                if node[0] in table or node[1] in table.values():
                    continue
                own = {s: n for (s, c), n in near[node].items() if table.get(s) == c}
                rivals = {s for (s, c), n in near[node].items() if s in table and table[s] != c and n >= least}
                if sum(own.values()) >= least and len(rivals - own.keys()) <= len(rivals & own.keys()):
                    best, mark = max((best, mark), (node, (len(own), sum(own.values()), node)), key=lambda x: x[1])
            if best is None:
                break
            table[best[0]] = best[1]
        weight = {s: (c, sum(n for (s2, c2), n in near[s, c].items() if table.get(s2) == c2)) for s, c in table.items()}
        if all(sum(known.get(s, (0,))[0] != c for s, c in table.items()) >= DIFFERENT for known in out):
            out.append(weight)
        left = {e: n for e, n in left.items() if not all(table.get(s) == c for s, c in e)}
    return out


@dataclass(frozen=True)
class Mapping:
    """One learned transformation. `reads`: the character each byte of a UTF-8 text was read as. Or `letters`: what each letter
    (an accented one with its tone apart, composed) became."""

    written: str
    read: str
    reads: tuple[tuple[int, str], ...] = ()
    letters: tuple[tuple[str, str], ...] = ()


def _agreement(table: dict[int, tuple[int, int]], of) -> float:
    total = sum(n for _, n in table.values())
    return sum(n for s, (c, n) in table.items() if of(s) == chr(c)) / total if total else 0.0


def byte_mappings(found: list[dict[int, tuple[int, int]]]) -> list[Mapping]:
    """A table of bytes completed by the public encodings that agree with it best (all, where it can't tell them apart); as
    inferred where none agrees, unless a tenth of it are marks and invisible characters: such come from composition and
    dirt between letters."""
    out: dict[str, Mapping] = {}
    for i, table in enumerate(found):
        share = {name: _agreement(table, chars.__getitem__) for name, chars in encodings().items()}
        most = max(share.values())
        if most >= AGREEMENT and len(table) >= LEAST_ASSIGNMENTS:
            for name in (n for n, x in share.items() if x == most):
                out.setdefault(name, Mapping("utf-8", name, tuple((b, c) for b, c in enumerate(encodings()[name]) if b >= 0x80 and c >= "\x80")))
        elif len(table) >= OWN_ASSIGNMENTS and 10 * sum(unicodedata.category(chr(c)) in ("Mn", "Cf") for c, _ in table.values()) < len(table):
            out[f"inferred {i}"] = Mapping("utf-8", f"inferred {i}", tuple((b, chr(c)) for b, (c, _) in sorted(table.items())))
    return list(out.values())


def letter_mappings(found: list[dict[int, tuple[int, int]]], alphabet: frozenset[int]) -> list[Mapping]:
    """A table of letters completed by the pair of public single-byte encodings (written, read) that agrees with it best. Without
    such a pair it is no evidence: letters also face each other in misspellings."""
    out: dict[tuple[str, str], Mapping] = {}
    for table in found:
        best, most, names = None, 0.0, ("", "")
        for written, chars in encodings().items():
            back = {c: b for b, c in reversed(list(enumerate(chars)))}
            if sum(chr(s) in back for s in table) < LETTER_ASSIGNMENTS:
                continue
            for read, seen in encodings().items():
                share = _agreement(table, lambda s: seen[back[chr(s)]] if chr(s) in back else None)  # noqa: B023
                if share > most:
                    best, most, names = (back, seen), share, (written, read)
        if best is None or most < AGREEMENT or len(table) < LETTER_ASSIGNMENTS:
            continue
        back, seen = best
        letters = {}
        for c in map(chr, sorted(alphabet)):
            apart = tones_apart(c)
            if all(x in back for x in apart):
                form = "".join(seen[back[x]] for x in apart)
                if form != c and not form.isascii():
                    letters.setdefault(form, c)
        out.setdefault(names, Mapping(*names, letters=tuple(sorted(letters.items()))))
    return list(out.values())


def infer(docs: DataFrame, *, text: str, least: int = LEAST_SUPPORT) -> tuple[list[Mapping], frozenset[int]]:
    """The mappings that all documents show, and the non-ASCII characters that occur twice or more; one read of the documents.

    Each word in a context is joined with the most frequent word of the same context, its clean near-twin (context: the
    words around it and itself, stripped of non-ASCII characters), and aligned with it. One twin per context, so the
    number of pairs never exceeds that of words in contexts. What goes to the driver is bounded by characters, not documents.
    """
    d = docs.select(F.col(text).alias("t")).filter(F.col("t").isNotNull())
    seen = spread(d).mapInArrow(_evidence, "key long, word string, kind int, n long").repartition("key").groupBy("key", "kind", "word").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("key")
    twin = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("n", "word"))).over(w)["word"]
    facing = seen.withColumn("twin", F.array(twin(0), twin(1))).filter("kind = 2 OR kind = 0")
    facing = facing.select("kind", "key", "word", "n", F.explode(F.when(F.col("kind") == 0, F.filter("twin", lambda x: x != F.col("word"))).otherwise(F.array(F.lit(None).cast("string")))).alias("twin"))
    char = F.when(F.col("kind") == 2, F.col("key").cast("int"))
    times = F.when(F.col("kind") == 2, F.col("n")).otherwise(1)  # a context counts once
    pairs = facing.groupBy("word", "twin", char.alias("char")).agg(F.sum(times).alias("n"))
    links = pairs.select("word", "twin", "n", "char").mapInArrow(_links, _LINKS).groupBy("kind", "s", "c", "s2", "c2").agg(F.sum("n").alias("n"))
    by_kind: tuple[dict, dict, dict] = ({}, {}, {})
    for r in links.filter("kind = 0 OR n >= 2").collect():
        by_kind[r["kind"]][((r["s"], r["c"]), (r["s2"], r["c2"]))] = r["n"]
    own = {x for (c, _), _ in by_kind[2] for x in (chr(c), chr(c).upper(), chr(c).lower()) if len(x) == 1}
    alphabet = frozenset(map(ord, (own | set(TONES)) - {REPLACED}))
    return byte_mappings(tables(by_kind[0], least)) + letter_mappings(tables(by_kind[1], least), alphabet), alphabet


def learn(docs: DataFrame, *, text: str, least: int = LEAST_SUPPORT) -> list[tuple[str, str]]:
    """The encodings (written, read) of the mappings that all documents show; `inferred` ones have no public name."""
    return [(m.written, m.read) for m in infer(docs, text=text, least=least)[0]]


class Reader:
    """Sequences of learned mappings in texts, and their replacement. A sequence is known by its mapping and the character it stands for."""

    def __init__(self, learned: list[Mapping], alphabet: frozenset[int]) -> None:
        self.learned = learned
        self.known = np.zeros(0x110000, bool)
        self.known[list(alphabet)] = True
        self.swap, self.table = [], []
        #: By group of 64 mappings, a bit each: where a character may begin a sequence of two, three or four, or continue one.
        self.masks = [np.zeros((5, 1 << 16), np.uint64) for _ in range(0, len(learned), 64)]
        self.byte = [np.zeros(1 << 16, np.uint8) for _ in learned]
        self.pairs: list[dict[tuple[str, str], int]] = []
        for i, m in enumerate(learned):
            bit, mask = np.uint64(1 << i % 64), self.masks[i // 64]
            parts: list[list[str]] = [[], [], [], []]
            for b, c in reversed(m.reads):
                if ord(c) > 0xFFFF:
                    continue
                self.byte[i][ord(c)] = b
                kind = 3 if b < 0xC0 else 0 if 0xC2 <= b < 0xE0 else 1 if 0xE0 <= b < 0xF0 else 2 if 0xF0 <= b < 0xF5 else None
                if kind is not None:
                    mask[kind, ord(c)] |= bit
                    parts[kind].append(re.escape(c))
            self.pairs.append({(s[0], s[1]): ord(c) for s, c in m.letters if len(s) == 2})
            for _, second in self.pairs[i]:
                if second >= "\x80" and ord(second) <= 0xFFFF:
                    mask[4, ord(second)] |= bit
            self.table.append(dict(m.letters))
            more = "[" + "".join(parts[3]) + "]"
            alts = [f"[{''.join(p)}]{more}{{{n}}}" for n, p in enumerate(parts[:3], 1) if p and parts[3]]
            if m.letters:
                alts = [re.escape(s) for s in sorted(self.table[i], key=lambda s: (-len(s), s))]
            self.swap.append(re.compile("|".join(alts) or r"(?!)"))

    def places(self, text: str) -> list[tuple[int, int, int]]:
        """(place, mapping, character) of all sequences in a text, those that the letters around them don't speak against."""
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.flatnonzero(cp >= 0x80)
        if not len(at):
            return []
        low = np.where(cp > 0xFFFF, 0, cp)
        low = np.concatenate([low, np.zeros(3, np.int64)])
        out = []
        for g, mask in enumerate(self.masks):
            c = [low[at + i] for i in range(4)]
            both = mask[3, c[1]]
            any_two, any_three = mask[0, c[0]] & both, mask[1, c[0]] & both & mask[3, c[2]]
            any_four = mask[2, c[0]] & both & mask[3, c[2]] & mask[3, c[3]]
            second = mask[4, c[0]]
            for size, hit in ((2, any_two), (3, any_three), (4, any_four)):
                some = np.flatnonzero(hit)
                for i in range(g * 64, min(len(self.learned), g * 64 + 64)):
                    own = some[(hit[some] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)]
                    if not len(own):
                        continue
                    b = [self.byte[i][x[own]].astype(np.int64) for x in c[:size]]
                    code = b[0] & (0xFF >> (size + 1))
                    for x in b[1:]:
                        code = code << 6 | x & 63
                    ok = (code >= (0x80, 0x800, 0x10000)[size - 2]) & (code < 0x110000) & self.known[np.minimum(code, 0x10FFFF)]
                    out += [(p, i, s) for p, s in zip(at[own[ok]].tolist(), code[ok].tolist()) if size > 2 or self._fits(text, p)]
            some = np.flatnonzero(second)
            for p in at[some].tolist() if len(some) else ():
                for i in range(g * 64, min(len(self.learned), g * 64 + 64)):
                    s = self.pairs[i].get((text[p - 1 : p], text[p]))
                    if s is not None:
                        out.append((p - 1, i, s))
        return out

    @staticmethod
    def _fits(text: str, at: int) -> bool:
        """Not for a pair that ends in an invisible character or blank (a letter before a no-break space, say) among capitals."""
        if not (text[at + 1].isspace() or unicodedata.category(text[at + 1]) == "Cf"):
            return True
        before, after = text[at - 1 : at], text[at + 2 : at + 3]
        return before.islower() or after.islower() or not (before.isalpha() or after.isalpha())

    def hits(self, text: str) -> dict[int, set[int]]:
        """The characters that the sequences of each mapping stand for."""
        out: dict[int, set[int]] = {}
        for _, i, s in self.places(text):
            out.setdefault(i, set()).add(s)
        return out

    def _clean(self, i: int, m: re.Match) -> str:
        s = m.group()
        if self.learned[i].letters:
            return self.table[i][s]
        try:
            c = bytes(int(self.byte[i][ord(x)]) for x in s).decode()
        except UnicodeDecodeError:
            return s
        return c if self.known[ord(c)] else s

    def restore(self, text: str, kept: list[set[int]], rounds: int = 4) -> str:
        """The text with the sequences of the best supported mapping replaced, again while any is left.

        A mapping whose replacements are also ordinary letters (single characters) is applied to a word only if the
        word holds a sequence of several characters, or if most words of the text do.
        """
        for _ in range(rounds):
            hits = {i: h & kept[i] for i, h in self.hits(text).items()}
            i = max(hits, key=lambda j: (len(hits[j]), -j), default=None)
            if i is None or not hits[i]:
                break
            change = lambda s: unicodedata.normalize("NFC", self.swap[i].sub(lambda m: self._clean(i, m), s))  # noqa: B023, E731
            if self.learned[i].letters:
                evident = {s for s, c in self.table[i].items() if len(s) > 1 and ord(c) in hits[i]}
                parts = re.split(r"(\s+)", text)
                odd = [p for p in parts if not p.isascii()]
                has = lambda p: any(s in p for s in evident)  # noqa: B023, E731
                most = sum(map(has, odd)) * 2 > len(odd)
                new = "".join(change(p) if not p.isascii() and (most or has(p)) else p for p in parts)
            else:
                new = change(text)
            if new == text:
                break
            text = new
        return text


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of PIECE_CHARS characters together, or one longer text."""
    a, filled = 0, 0
    for i, t in enumerate(texts):
        if filled and filled + len(t) > PIECE_CHARS:
            yield a, i
            a, filled = i, 0
        filled += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def _scan(reader_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*reader_b.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found: dict[int, dict[int, set[int]]] = {i: {} for i, t in enumerate(texts) if REPLACED in t}
            for a, b in _pieces(texts):
                starts = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
                places = reader.places("\n".join(texts[a:b]))
                rows = np.searchsorted(starts, [p for p, _, _ in places], side="right") - 1 + a
                for row, (_, i, s) in zip(rows.tolist(), places):
                    found.setdefault(row, {}).setdefault(i, set()).add(s)
            place = sorted(found)
            hits, alone = [], []
            for row in place:
                most = max(map(len, found[row].values()), default=0)
                own = [(i << 32 | s, len(h) == 1 or 2 * len(h) < most) for i, h in sorted(found[row].items()) for s in sorted(h)]
                hits.append([h for h, _ in own])
                alone.append([x for _, x in own])
            lost = [REPLACED in texts[i] for i in place]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(place, pa.int64())), pa.array(lost, pa.bool_()), pa.array(hits, pa.list_(pa.int64())), pa.array(alone, pa.list_(pa.bool_()))], ["k", "lost", "hits", "alone"]
            )

    return run


@dataclass
class Findings:
    """What was learned, and the documents with evidence: k, lost (holds a replacement character), hits (mapping and character), alone."""

    learned: list[Mapping]
    alphabet: frozenset[int]
    rows: DataFrame
    kept: list[set[int]] = field(default_factory=list)


def find(docs: DataFrame, *, doc_id: str, text: str, least: int = LEAST_SUPPORT) -> Findings:
    """Learn, scan all documents once, and drop sequences that are ordinary text.

    A sequence is ordinary if it mostly stands alone: as the only one of its mapping in a document, or where another
    mapping shows more than twice as many. Damage shows in many sequences, chance neighbours don't. A sequence of
    too few documents to tell counts if it has company there or is three characters long or more.
    """
    key = docs.schema[doc_id].dataType.simpleString()
    learned, alphabet = infer(docs, text=text, least=least)
    reader_b = docs.sparkSession.sparkContext.broadcast((learned, alphabet))
    slim = spread(docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull()))
    rows = cut(slim.mapInArrow(_scan(reader_b), f"k {key}, lost boolean, hits array<long>, alone array<boolean>"))
    out = Findings(learned, alphabet, rows, [set() for _ in learned])
    each = rows.select(F.explode(F.arrays_zip("hits", "alone")).alias("h")).groupBy("h.hits")
    for r in each.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h.alone")).alias("alone")).collect() if learned else ():
        i, s = r["hits"] >> 32, r["hits"] & 0xFFFFFFFF
        if r["alone"] < ALONE_SHARE * r["n"] or (r["n"] < 3 and s >= 0x800 and learned[i].reads):
            out.kept[i].add(s)
    return out


def _evident(f: Findings) -> DataFrame:
    spark = f.rows.sparkSession
    names = [(i << 32 | s,) for i, k in enumerate(f.kept) for s in sorted(k)]
    kept = F.broadcast(spark.createDataFrame(names, "hit long"))  # a number for each mapping and character: some thousands
    sure = f.rows.select("k", F.explode("hits").alias("hit")).join(kept, "hit", "left_semi").select("k")
    return sure.unionByName(f.rows.filter("lost").select("k")).distinct()


def garbled(docs: DataFrame, *, doc_id: str, text: str, least: int = LEAST_SUPPORT) -> DataFrame:
    """doc_id of each document with characters that come from a wrong decoding, once.

    Null, empty and plain ASCII texts have none. A replacement character counts, though what it stood for is lost.
    Where nothing can be learned (tiny tables), only replacement characters are found. Other columns are ignored.
    """
    return _evident(find(docs, doc_id=doc_id, text=text, least=least)).withColumnRenamed("k", doc_id)


def restored(docs: DataFrame, *, doc_id: str, text: str, least: int = LEAST_SUPPORT) -> DataFrame:
    """doc_id, text_restored, is_complete for each garbled document: the text with all learned sequences replaced, in as many
    rounds as it was misread; is_complete says that neither replacement characters nor known sequences are left."""
    f = find(docs, doc_id=doc_id, text=text, least=least)
    key = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((f.learned, f.alphabet, f.kept))
    bad = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).join(_evident(f), "k", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, alphabet, kept = sent.value
        reader = Reader(learned, alphabet)
        for batch in batches:
            new = [reader.restore(t, kept) for t in batch.column(1).to_pylist()]
            whole = [REPLACED not in t and not any(h & kept[i] for i, h in reader.hits(t).items()) for t in new]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()), pa.array(whole, pa.bool_())], ["k", "t", "c"])

    return bad.mapInArrow(run, f"k {key}, t string, c boolean").select(F.col("k").alias(doc_id), F.col("t").alias("text_restored"), F.col("c").alias("is_complete"))
