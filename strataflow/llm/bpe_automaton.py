"""Byte-pair encoding by a deterministic automaton that is compiled from the merges.

The automaton reads tokens. At first one state loops on every base symbol. For each merge (u, v) -> w, in order, a gadget
is added: let q be where u leads and r where v leads from q; u is led to a copy of q that has lost its arc v, and w is
led to r wherever u could be read. Where u leads depends on u alone, so the finished automaton is a table from the token
read last to the tokens that may follow, and it accepts exactly one token sequence for each word: its BPE encoding.

`Gadgets` adds the gadgets one after the other; a copy is kept as its origin and the one arc that it lost. `Automaton` is
the table made of them: a bit for each class of states (with equal arcs) and each class of arcs (that leave the same
states), and the trie of the arc labels as a hash table. Words are encoded by table look-ups alone, many words at a time:
all arcs that could start at each byte are found through the trie; then, place by place, the one arc is taken that the
state reached before it has. A word's prefixes are words too, so one pass from left to right finds the sequence. Decoding
emits the labels.

Text is normalised and cut into words as the tokenizer file says (see lexer). Special tokens in a text are cut out first,
as the library does.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import bounded_batches, lean, table
from strataflow.llm.lexer import Lexer, byte_chars, list_array

END = 256  # added to a word's last byte where the file marks word ends
PIECES = 150_000  # a task's pieces: beside the tables, two workers of an executor hold them twice
WORD_BYTES = 1 << 17  # of words encoded at a time: about 200 times that is held
_HASH = np.uint64(0x9E3779B97F4A7C15)


class Gadgets:
    """The automaton after each merge, state by state."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        chars = byte_chars()
        self.base = {}
        for b, c in enumerate(chars):
            for symbol, name in ((b, c), (b + END, c + suffix)):
                if (suffix or symbol < END) and name in vocab:
                    self.base[symbol] = vocab[name]
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}  # the merge's rank
        self.lost: dict[int, list[tuple[int, int]]] = defaultdict(list)  # u -> (when, v): copies of u's target that lost v
        self.rule: dict[int, int] = {}  # u << 32 | v -> when
        self.spelled: dict[int, tuple[int, ...]] = {i: (s,) for s, i in self.base.items()}
        made = {a + b: rank for rank, (a, b) in enumerate(merges)}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if max(made.get(a, -1), made.get(b, -1)) >= rank:
                raise ValueError(f"the merge of {a!r} and {b!r} comes before its parts")
            if u not in self.spelled or v not in self.spelled:
                continue  # made of a token that no text reaches
            if w in self.spelled:
                raise ValueError(f"two merges make {a + b!r}")
            if not self.follows(u, v):
                continue  # v can't be read after u: the merge never applies
            self.rule[u << 32 | v] = self.born[w] = rank
            self.lost[u].append((rank, v))
            self.left[w], self.right[w] = u, v
            self.spelled[w] = self.spelled[u] + self.spelled[v]

    def follows(self, u: int, x: int) -> bool:
        """Whether arc x leaves the state that u leads to.

        That state came from copies: of u's own (one for each merge with u at its left), before u was born of those of
        its right part, and so on. Arc x was added with its left part's arc, so below its birth that one counts.
        """
        until = 1 << 60
        born, rule, left, right = self.born, self.rule, self.left, self.right
        while True:
            lost = rule.get(u << 32 | x)
            if lost is not None and lost < until:
                return False
            bu, bx = born.get(u, -1), born.get(x, -1)
            if bu < 0 and bx < 0:
                return True
            if bu > bx:
                until, u = min(until, bu), right[u]  # as r was before the gadget
            else:
                until, x = min(until, bx + 1), left[x]  # a copy that had lost left[x] by then has no x either


class Automaton:
    """The compiled tables; encode_words() maps words to ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        made = Gadgets(vocab, merges, suffix)
        self.marked = bool(suffix)
        size = max(vocab.values(), default=0) + 1
        self.tabulate(made, size)
        self.index(made)

    def tabulate(self, made: Gadgets, size: int) -> None:
        """rows: the packed arcs of each class of states; row_of, column_of: a token's class as a state and as an arc.

        Arcs are laid out so that those which came with an arc a, and with those, stand behind it in order of birth: a
        state that loses a at some time has lost a, and a's followers born since, which are one range. So a state's arcs
        are its origin's, with the ranges back that the origin lost after the copy was made, without those lost since.
        """
        kids: dict[int, list[int]] = defaultdict(list)
        heirs: dict[int, list[int]] = defaultdict(list)
        for w in made.left:  # in order of birth
            kids[made.left[w]].append(w)
            heirs[made.right[w]].append(w)
        place, stop, order = {}, {}, []
        todo = [(x, False) for x in sorted(made.base.values(), reverse=True)]
        while todo:
            x, left_behind = todo.pop()
            if left_behind:
                stop[x] = len(order)
                continue
            place[x] = len(order)
            order.append(x)
            todo.append((x, True))
            todo += [(w, False) for w in reversed(kids[x])]
        births = {x: [made.born[w] for w in ws] for x, ws in kids.items() if ws}

        def since(x: int, when: int) -> int:
            """Where the followers of arc x start that were born at `when` or later."""
            at = bisect_left(births.get(x, []), when)
            return place[kids[x][at]] if at < len(births.get(x, [])) else stop[x]

        # arcs without followers, that start no state's loss and came with the same arc between two losses of it, leave the same states
        gone_at = {v: [made.born[w] for w in ws] for v, ws in heirs.items()}
        columns: dict[tuple, int] = {}
        self.column_of = np.zeros(size, np.int32)
        shown = []
        for x in order:
            leaf = x in made.left and x not in births and x not in gone_at
            alike = (made.left[x], bisect_right(gone_at.get(made.left[x], []), made.born[x])) if leaf else (x,)
            if alike not in columns:
                columns[alike] = len(shown)
                shown.append(place[x])
            self.column_of[x] = columns[alike]
        here = np.searchsorted(shown, np.arange(len(order) + 1))  # where a place is among the shown ones
        ranges = {u: np.array([(when, here[place[v]], here[since(v, when)], here[stop[v]]) for when, v in gone]) for u, gone in made.lost.items()}
        none = np.zeros((0, 4), np.int64)

        def put(arcs: np.ndarray, ranges: np.ndarray, bit: int) -> None:
            arcs[ranges[:, 1]] = bit
            if len(ranges) < 100:
                for lo, hi in ranges[:, 2:].tolist():
                    arcs[lo:hi] = bit
            else:
                opened = np.bincount(ranges[:, 2], minlength=len(arcs) + 1) - np.bincount(ranges[:, 3], minlength=len(arcs) + 1)
                arcs[np.cumsum(opened[:-1]) > 0] = bit

        final = {i for s, i in made.base.items() if s >= END}
        self.row_of = np.zeros(size, np.int32)
        classes: dict[bytes, int] = {}
        stack = [(x, np.ones(len(shown), np.uint8), none) for x in made.base.values() if x not in final]
        while stack:
            u, origin, back = stack.pop()
            arcs, gone = origin.copy(), ranges.get(u, none)
            put(arcs, back[np.searchsorted(back[:, 0], made.born.get(u, -1)) :], 1)
            put(arcs, gone, 0)
            self.row_of[u] = classes.setdefault(np.packbits(arcs).tobytes(), len(classes))
            stack += [(w, arcs, gone) for w in heirs.get(u, [])]
        width = (len(shown) + 7) // 8
        self.rows = np.frombuffer(b"".join(classes), np.uint8).reshape(len(classes), width)

    def index(self, made: Gadgets) -> None:
        """The trie of arc labels: (node, symbol) -> node by open addressing, and the token that ends at each node."""
        child: dict[int, int] = {}
        token = [-1]
        for i, symbols in made.spelled.items():
            node = 0
            for s in symbols:
                key = node * 512 + s
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(token)
                    token.append(-1)
                node = nxt
            token[node] = i
        self.token = np.array(token, np.int32)
        keys, nodes = np.array(list(child), np.int64), np.array(list(child.values()), np.int32)
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.slots, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):
            free = self.slots[slot[left]] < 0
            _, first = np.unique(np.where(free, slot[left], -1 - left), return_index=True)
            first = first[free[first]]
            self.slots[slot[left[first]]], self.nodes[slot[left[first]]] = keys[left[first]], nodes[left[first]]
            left = np.delete(left, first)
            slot[left] = (slot[left] + 1) % (1 << self.bits)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The trie's next nodes, 0 where there is none."""
        keys = node.astype(np.int64) * 512 + symbol
        slot = self.slot(keys)
        held = self.slots[slot]
        out = np.where(held == keys, self.nodes[slot], 0)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % (1 << self.bits)
            held = self.slots[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def encode(self, word: bytes) -> list[int]:
        return self.encode_some([word])[1].tolist()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all words."""
        counts, values, part, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [], 0
        for word in words:
            part.append(word.encode())
            size += len(part[-1])
            if size > WORD_BYTES:
                c, v = self.encode_some(part)
                counts.append(c)
                values.append(v)
                part, size = [], 0
        if part:
            c, v = self.encode_some(part)
            counts.append(c)
            values.append(v)
        return np.concatenate(counts), np.concatenate(values)

    def encode_some(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        if self.marked:
            symbols[ends[sizes > 0] - 1] += END
        word = np.repeat(np.arange(len(words)), sizes)
        first, stop = begins[word], ends[word]

        # every arc whose label stands somewhere: where it begins and ends
        at, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int32), 0
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]]
        while len(at):
            node = self.step(node, symbols[at + depth])
            at, node = at[node > 0], node[node > 0]
            depth += 1
            token = self.token[node]
            arc = token >= 0
            for out, x in zip(found, (at[arc], at[arc] + depth, token[arc]), strict=True):
                out.append(x)
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        a, b, x = map(np.concatenate, found)
        place = b - first[a]  # places are gone through in order, for all words at once
        by = np.argsort(place, kind="stable")
        a, b, x = a[by], b[by], x[by]
        cuts = np.searchsorted(place[by], np.arange(1, sizes.max(initial=0) + 2))
        last, back = np.full(len(symbols) + 1, -1, np.int32), np.zeros(len(symbols) + 1, np.int64)  # of the prefix that ends there
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            a1, b1, x1 = a[lo:hi], b[lo:hi], x[lo:hi]
            inner = a1 != first[a1]
            state, column = np.where(inner, last[a1], 0), self.column_of[x1]
            bit = self.rows[self.row_of[state], column >> 3] >> (7 - (column & 7)) & 1
            ok = ~inner | ((state >= 0) & (bit == 1))
            last[b1[ok]], back[b1[ok]] = x1[ok], a1[ok]

        at, owner, seen = ends[sizes > 0], np.flatnonzero(sizes > 0), []
        if (last[at] < 0).any():
            raise ValueError("the vocabulary lacks a byte of the word")
        while len(at):
            seen.append((owner, last[at]))
            at = back[at]
            more = at > begins[owner]
            at, owner = at[more], owner[more]
        counts = np.zeros(len(words), np.int64)
        for owner, _ in seen:
            counts[owner] += 1
        after = np.cumsum(counts)
        values = np.zeros(int(counts.sum()), np.int32)
        for n, (owner, token) in enumerate(seen):
            values[after[owner] - 1 - n] = token
        return counts, values


def compiled(spec: str) -> Automaton:
    model = json.loads(spec)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")


def automaton_lexer(spec: str, machine: Automaton) -> Lexer:
    return Lexer(spec, "<i4", machine.encode_words, PIECES)


def tokenizer_spec(path: str) -> str:
    """The tokenizer file's text, read once on the driver and broadcast (its size is the vocabulary's)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def arc_labels(spec: str) -> list[str | None]:
    """Label by id: a token's spelling as the vocabulary writes it, or a special token's text."""
    parsed = json.loads(spec)
    if parsed["decoder"] is not None:
        raise ValueError("only files without a decoder section are decoded by arc labels")
    names = {i: t for t, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}
    return [names.get(i) for i in range(max(names) + 1)]


def decoded(ids: list[int | None], labels: list[str | None]) -> str:
    """The labels joined by blanks, as for files without a decoder; ids beyond the vocabulary are left out, as the library does."""
    return " ".join(t for i in ids if i is not None and 0 <= i < len(labels) and (t := labels[i]) is not None)


def parts(batch: pa.RecordBatch, column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `budget` bytes of a string column, one row at least."""
    ends = np.cumsum([x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()])
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode_documents(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, ids (array of int) for each row, by the automaton; with `decode` also decoded, the text that the ids give.

    A null text is empty; an empty text gives an empty array; null and repeated ids are kept as they are; an empty table
    gives none; long texts are encoded whole, in memory that grows with the text; other columns are not read. A row's
    text is encoded by itself, so nothing is grouped and no row waits for another.
    """
    bounded_batches(documents.sparkSession)
    spec = tokenizer_spec(path)
    context = documents.sparkSession.sparkContext
    shared = context.broadcast((json.dumps(json.loads(spec) | {"model": {"type": "BPE", "vocab": {}, "merges": []}}), compiled(spec), arc_labels(spec) if decode else None))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare, machine, labels = shared.value
        lexer = automaton_lexer(bare, machine)
        for batch in batches:
            for part in parts(batch, "text"):
                offsets, ids = lexer.encode(part.column("text").to_pylist())
                columns = {"doc_id": part.column("doc_id"), "ids": list_array(offsets, ids)}
                if decode:
                    names = list(map(labels.__getitem__, ids.tolist()))
                    columns["decoded"] = pa.array([" ".join(names[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return _texts(documents, id_col, text_col).mapInArrow(lean(encode), "doc_id long, ids array<int>" + ", decoded string" * decode)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded for each row of encoded(doc_id, ids): the arc labels, joined. Null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(arc_labels(tokenizer_spec(path)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decoded(ids or [], shared.value) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(both: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows doc_id, ids, decoded."""
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(table(spark, sf_dir, "documents"), vocabulary(), decode=True))
