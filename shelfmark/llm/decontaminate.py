"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units give typed placeholders (slots), other words are
lower-cased. A currency sign before a number counts as a unit behind it, number words after a number
belong to it, and a capitalised word that starts a sentence is a name unless it is one that often does.
Items with the same template whose slots repeat alike form a class, and classes are searched, not items.

Windows of template tokens are joined by their hashes. Of each class only the rarest windows are in the
table: so many that a document which holds enough of the others holds one of these. Documents are
scanned once; a bit map of fixed size, broadcast, tells which windows may be in the table, and only
documents with such windows go on to the hash join. Documents and classes that meet are compared on the
template tokens themselves, and the slots must fit together at each place: each value of the item stands
for one value there and the other way round, which tells re-parameterised questions from chance. A
document leaks an item if the windows that fit, in a stretch of the item's length, cover enough of it.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name, row_key

WINDOW = 5
#: Share of an item's windows that a leak covers.
COVER = 0.5
#: The bit map has a thousand bits for each window of the table, but no more than this power of two (32 MB).
MAP_BITS = 28
#: Characters of text that are canonicalised at once (a longer text is taken alone).
CHARS = 1_000_000
#: Distinct words after which a task forgets those it has seen.
KNOWN = 1_000_000

# Words read as numbers, units where they follow a number, and words that start sentences without being names.
NUMBER_WORDS = frozenset(
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce ounces "
    "l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur percent pct degree degrees c f k kelvin watt watts w kw volt volts v amp amps hz mhz ghz bit bits byte bytes kb mb gb tb mph kmh".split()
)
STARTERS = frozenset(
    "a an the this that these those i you he she it we they my your his her its our their there here what which who whom whose when where why how "
    "is are was were be do does did has have had can could will would shall should may might must let if then else so and or but nor for yet of in on at by to from with "
    "without within into onto over under above below between among during before after since until while as than because although though however therefore thus hence "
    "not no yes all any some each every both either neither many much more most few several other another such only also just even now once again still first next last finally "
    "find calculate compute determine solve give given write show prove explain describe choose select name list state suppose assume consider using use".split()
)
CURRENCY = frozenset("$€£")
TOKEN = re.compile(r"\d[\d.,]*\d|\d|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?]|[%$€£°]")
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
KINDS = {1: NAME, 2: NUM, 3: UNIT}
P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


class Lexicon(dict):
    """Token numbers for each white-space separated word, with what each token is; grows on demand."""

    def __init__(self) -> None:
        super().__init__()
        self.of: dict[str, int] = {}
        self.plain: list[str] = []
        self.hash = array("Q")
        # 0 word, 1 capitalised, 2 number, 3 unit word, 4 sentence end, 5 number word, 6 capitalised word that often starts a sentence
        self.kind = array("b")
        self.end = self.number("\n")

    def __missing__(self, word: str) -> tuple[int, ...]:
        if word.isalpha():
            found = (self.number(word),)
        else:
            tokens = TOKEN.findall(word)
            for i in range(len(tokens) - 1):
                if tokens[i] in CURRENCY and tokens[i + 1][0].isdigit():
                    tokens[i], tokens[i + 1] = tokens[i + 1], tokens[i]
            found = tuple(map(self.number, tokens))
        self[word] = found
        return found

    def number(self, token: str) -> int:
        if token in self.of:
            return self.of[token]
        low = token.lower()
        if token in (".", "!", "?", "\n"):
            kind = 4
        elif token[0].isdigit():
            kind = 2
        elif low in NUMBER_WORDS:
            kind = 5
        elif low in UNITS or not token[0].isalpha():
            kind = 3
        elif token[0].isupper() and len(token) > 1 and token[1:].islower():
            kind = 6 if low in STARTERS else 1
        else:
            kind = 0
        self.plain.append(low)
        self.hash.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass"), 1))
        self.kind.append(kind)
        self.of[token] = n = len(self.plain) - 1
        return n


def canonical(texts: list[str], lexicon: Lexicon) -> dict[str, np.ndarray]:
    """Template tokens of several texts: ``doc`` (which text), ``hash``, ``slot`` (0 word, 1 name,
    2 number, 3 unit) and ``raw`` (index of the token in the lexicon; of a name or number its first word)."""
    ids: list[int] = []
    doc = []
    of, end = lexicon.__getitem__, lexicon.end
    for text in texts:
        before = len(ids)
        for line in text.split("\n"):
            ids.extend(chain.from_iterable(map(of, line.split())))
            ids.append(end)
        doc.append(len(ids) - before)
    raw = np.array(ids, dtype=np.int64)
    which = np.repeat(np.arange(len(texts)), doc)
    kind = np.frombuffer(lexicon.kind, dtype=np.int8)[raw]
    follows = np.zeros(len(raw), dtype=bool)  # not at the start of a sentence
    follows[1:] = (kind[:-1] != 4) & (which[1:] == which[:-1])
    slot = np.zeros(len(raw), dtype=np.int8)
    slot[(kind == 1) | ((kind == 6) & follows)] = 1
    number = (kind == 2) | (kind == 5)
    slot[number] = 2
    slot[1:][(kind[1:] == 3) & number[:-1] & follows[1:]] = 3
    keep = kind != 4
    # Names of several words are one slot, and so are numbers with the words that belong to them.
    keep[1:] &= ~(follows[1:] & (slot[:-1] == slot[1:]) & ((slot[1:] == 1) | (kind[1:] == 5)))
    h = np.frombuffer(lexicon.hash, dtype=np.uint64)[raw]
    for s in (1, 2, 3):
        h[slot == s] = np.uint64(s)
    return {"doc": which[keep], "hash": h[keep], "slot": slot[keep], "raw": raw[keep]}


def window_hashes(c: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` tokens, and which of them lie in one text."""
    n = len(c["hash"]) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.full(n, np.uint64(width), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = _mix(out * P + c["hash"][i : i + n])
    return out, c["doc"][width - 1 :] == c["doc"][:n]


class Item:
    """A class of benchmark items: template tokens, and for each slot which value of its kind it is, by
    first appearance (-1 for words)."""

    __slots__ = ("slots", "tokens", "width")

    def __init__(self, tokens: list[str], slots: list[int], width: int) -> None:
        self.tokens, self.slots, self.width = list(tokens), list(slots), min(width, len(tokens))

    @classmethod
    def read(cls, text: str, width: int) -> Item:
        return cls.windowed(text, width)[0]

    @classmethod
    def windowed(cls, text: str, width: int) -> tuple[Item, list[int]]:
        lexicon = Lexicon()
        c = canonical([text], lexicon)
        values = [lexicon.plain[r] for r in c["raw"]]
        tokens = [KINDS.get(int(s), v) for s, v in zip(c["slot"], values, strict=True)]
        seen: dict[str, dict[str, int]] = {}
        slots = [seen.setdefault(t, {}).setdefault(v, len(seen[t])) if s else -1 for t, v, s in zip(tokens, values, c["slot"], strict=True)]
        item = cls(tokens, slots, width)
        return item, window_hashes(c, item.width)[0].tolist() if item.width else []

    @property
    def windows(self) -> int:
        return len(self.tokens) - self.width + 1 if self.tokens else 0


def _agreeing(hits: list[tuple[int, int]], pairs: list[list[tuple]], near: list[int]) -> list[tuple[int, int]]:
    """Hits whose slots agree with one reading: the values of the nearest hits first, of those the most frequent."""
    first: dict = {}
    votes: Counter = Counter()
    for own, far in zip(pairs, near, strict=True):
        for p in own:
            first[p] = min(far, first.get(p, far))
    for own, far in zip(pairs, near, strict=True):
        votes.update({p for p in own if first[p] == far})
    there: dict = {}
    back: dict = {}
    for kind, a, b in sorted(votes, key=lambda p: (first[p], -votes[p], p)):
        if (kind, a) not in there and (kind, b) not in back:
            there[kind, a], back[kind, b] = b, a
    return [h for h, own in zip(hits, pairs, strict=True) if all(there.get((k, a)) == b for k, a, b in own)]


def covered(hits: list[tuple[int, int]], item: Item, values: dict[int, str], tokens: dict[int, str]) -> int:
    """Most distinct windows of the item that one place of the document holds with slots that agree.

    Hits (item position, document position) that stand alike, by document position minus item position,
    are one place; other hits in its stretch count where they agree with it, so places that hold the
    item with other values do not spoil one another. The reading of the whole document is one more try.
    """
    hits = sorted(hits, key=lambda h: (h[1], h[0]))
    pairs = [[(item.tokens[at + i], item.slots[at + i], values[pos + i]) for i in range(item.width) if item.slots[at + i] >= 0] for at, pos in hits]
    best = best_cover(_agreeing(hits, pairs, [0] * len(hits)), item)
    spots, size = [pos for _, pos in hits], len(item.tokens)
    for place, _ in Counter(pos - at for at, pos in hits).most_common():
        if best == item.windows:
            break
        lo, hi = bisect_left(spots, place - size // 2), bisect_right(spots, place + size + size // 2)
        some = hits[lo:hi]
        if len({at for at, _ in some}) > best:
            near = [abs(pos - at - place) for at, pos in some]
            best = max(best, best_cover(_agreeing(some, pairs[lo:hi], near), item))
    return best


def best_cover(hits: list[tuple[int, int]], item: Item) -> int:
    """Most distinct windows of the item among hits within a stretch of its own length and a half."""
    hits = sorted((pos, at) for at, pos in hits)
    reach, best, lo, inside = len(item.tokens) * 3 // 2, 0, 0, Counter()
    for pos, at in hits:
        inside[at] += 1
        while hits[lo][0] < pos - reach:
            inside[hits[lo][1]] -= 1
            if not inside[hits[lo][1]]:
                del inside[hits[lo][1]]
            lo += 1
        best = max(best, len(inside))
    return best


def _need(windows: int, cover: float) -> int:
    return max(1, int(np.ceil(cover * windows - 1e-9)))


def found_in(text: str, items: list[Item], cover: float) -> list[int]:
    """Windows of each item that the text covers; 0 if they are too few for a leak."""
    lexicon = Lexicon()
    c = canonical([text], lexicon)
    values = [lexicon.plain[r] for r in c["raw"]]
    tokens = [KINDS.get(int(s), v) for s, v in zip(c["slot"], values, strict=True)]
    by: dict[int, dict[tuple[str, ...], list[int]]] = {}
    for width in {x.width for x in items}:
        wanted = {tuple(x.tokens[at : at + width]) for x in items if x.width == width for at in range(x.windows)}
        spots = by[width] = {}
        for pos in range(len(tokens) - width + 1):
            w = tuple(tokens[pos : pos + width])
            if w in wanted:
                spots.setdefault(w, []).append(pos)
    out = []
    for item in items:
        spots, need = by[item.width], _need(item.windows, cover)
        hits = [(at, pos) for at in range(item.windows) for pos in spots.get(tuple(item.tokens[at : at + item.width]), ())]
        got = covered(hits, item, values, tokens) if len({at for at, _ in hits}) >= need else 0
        out.append(got if got >= need else 0)
    return out


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def classes(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per class of items: ``class`` (a digest), ``item`` (its smallest id), ``n_items``, ``tokens,
    slots`` and ``windows`` (structs of position and hash). Items without tokens have no class."""
    return _classed(benchmark, item_col, item_text, window).groupBy("class").agg(
        F.min("item").alias("item"), F.count("*").alias("n_items"), *[F.first(c).alias(c) for c in ("tokens", "slots", "windows")]
    )


def item_classes(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Which item stands for each item in ``leaks``: ``item_col``, ``leads``; items without tokens are left out."""
    each = _classed(benchmark, item_col, item_text, window).select("class", "item")
    lead = each.groupBy("class").agg(F.min("item").alias("leads"))
    return each.join(lead, "class").select(F.col("item").alias(item_col), "leads")


def _classed(benchmark: DataFrame, item_col: str, item_text: str, window: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["item"], b["text"], strict=True):
                item, hashes = Item.windowed(t, window)
                if hashes:
                    rows.append((i, item.tokens, item.slots, [{"at": at, "h": np.uint64(h).view(np.int64)} for at, h in enumerate(hashes)]))
            yield pd.DataFrame(rows, columns=["item", "tokens", "slots", "windows"])

    some = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    made = some.mapInPandas(run, "item string, tokens array<string>, slots array<int>, windows array<struct<at int, h long>>")
    kind = benchmark.schema[item_col].dataType
    digest = F.sha2(F.concat(F.array_join("tokens", "\n"), F.lit("\n\n"), F.array_join(F.col("slots").cast("array<string>"), " ")), 256)
    return made.withColumn("class", digest).withColumn("item", F.col("item").cast(kind))


def _lookups(kinds: DataFrame, cover: float) -> DataFrame:
    """``h, class``: of each class the rarest windows, one more than a document that leaks it may lack."""
    each = kinds.select("class", F.size("windows").alias("n"), F.explode("windows").alias("w")).select("class", "n", "w.h", "w.at")
    common = each.groupBy("h").agg(F.count("*").alias("many"))
    row = F.struct("many", "h", "at")
    per = each.join(common, "h").groupBy("class", "n").agg(F.sort_array(F.collect_list(row)).alias("w"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(cover) * F.col("n") - 1e-9))
    first = F.slice("w", F.lit(1), (F.col("n") - need + 1).cast("int"))
    return per.select("class", F.explode(F.array_distinct(F.transform(first, lambda w: w["h"]))).alias("h"))


def _bit_map(lookups: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a map with two bits set for each hash; what comes to the driver is one long per word of it."""
    word = lambda at: F.shiftrightunsigned(at, 6)
    at = F.explode(F.array(*_places(F.col("h"), bits)))
    spots = lookups.select(at.alias("at"))
    words = spots.groupBy(word(F.col("at")).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    found = words.toPandas()
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def _places(h, bits: int) -> list:
    """Two places in the map for a hash, of a column or of an array of unsigned numbers."""
    if isinstance(h, np.ndarray):
        return [h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)]
    return [F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    cover: float = COVER,
) -> DataFrame:
    """One row per document and class of benchmark items that it leaks: id, the class's smallest item id,
    ``n_items`` (items of the class), ``windows_found, windows, coverage``, and the ``row_key`` of the row.

    A class is given once, however many items it has: ``item_classes`` tells them. Null and empty texts
    and items leak nothing; items shorter than a window are one window. Repeated rows each give their
    rows; ids may be null. Empty tables give an empty result. Columns other than id and text are ignored,
    whatever their names. Whole texts are searched.
    """
    spark = docs.sparkSession
    kinds = checkpoint(classes(benchmark, item_col, item_text, window))
    lookups = checkpoint(_lookups(kinds, cover))
    widths = sorted(r[0] for r in kinds.select(F.least(F.size("tokens"), F.lit(window))).distinct().collect())
    bits = min(MAP_BITS, max(16, int(lookups.count() * 1000).bit_length()))
    shared = spark.sparkContext.broadcast((_bit_map(lookups, bits), bits, widths))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bit_map, bits, widths = shared.value
        lexicon = Lexicon()
        for b in batches:
            texts, rows = b["text"].tolist(), []
            for lo, hi in _batches(texts):
                if len(lexicon) > KNOWN:
                    lexicon = Lexicon()
                c = canonical(texts[lo:hi], lexicon)
                found: dict[int, list[np.ndarray]] = {}
                for width in widths:
                    h, whole = window_hashes(c, width)
                    for at in _places(h, bits):
                        whole &= (bit_map[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                    hit = np.flatnonzero(whole)
                    which, first = np.unique(c["doc"][hit], return_index=True)
                    for d, part in zip(which.tolist(), np.split(h[hit], first[1:]), strict=True) if len(hit) else ():
                        found.setdefault(d, []).append(part)
                for d, parts in found.items():
                    n = lo + d
                    rows.append((b["uid"].iloc[n], b["id"].iloc[n], b["key"].iloc[n], texts[n], np.unique(np.concatenate(parts)).view(np.int64)))
            yield pd.DataFrame(rows, columns=["uid", "id", "key", "text", "h"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                items = [Item(x["tokens"], x["slots"], window) for x in r.kinds]
                for x, item, got in zip(r.kinds, items, found_in(r.text, items, cover), strict=True):
                    if got:
                        rows.append((r.id, r.key, x["class"], got, item.windows))
            yield pd.DataFrame(rows, columns=["id", "key", "class", "found", "windows"])

    slim = docs.select(F.col(id_col).cast("string").alias("id"), row_key(F.col(id_col), F.col(text)).alias("key"), F.col(text).alias("text"))
    slim = slim.withColumn("uid", F.monotonically_increasing_id()).where(F.length("text") > 0)
    maybe = checkpoint(slim.mapInPandas(scan, "uid long, id string, key string, text string, h array<long>"))
    met = maybe.select("uid", F.explode("h").alias("h")).join(lookups, "h").select("uid", "class").distinct()
    one = F.struct("class", "tokens", "slots").alias("kind")
    per = met.join(kinds.select("class", one), "class").groupBy("uid").agg(F.collect_list("kind").alias("kinds"))
    rows = maybe.drop("h").join(per, "uid").select("id", "key", "text", "kinds")
    out = rows.mapInPandas(compare, "id string, key string, class string, found long, windows long")
    out = out.join(kinds.select("class", "item", "n_items"), "class")
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("item").alias(item_col),
        "n_items",
        F.col("found").alias("windows_found"),
        "windows",
        (F.col("found") / F.col("windows")).alias("coverage"),
        F.col("key").alias("row_key"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that leak no item, with the columns of ``docs``; repeated rows stay."""
    bad = leaks(docs, benchmark, id_col, text, **options).select(F.col("row_key")).distinct()
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key(F.col(id_col), F.col(text)))
    return keyed.join(bad.withColumnRenamed("row_key", key), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
