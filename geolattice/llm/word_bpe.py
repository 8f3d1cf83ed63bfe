"""BPE encoding and decoding (operator 6): prefix-sharing trie traversal.

The encoding of a prefix of a word is the encoding of a shorter prefix and one more token, the *last token*, and
two neighbouring tokens are right wherever merging their symbols alone gives these two again. So the distinct
pre-tokens of a batch are laid out as a trie, and one depth-first walk gives every node its last token from the last
tokens of its ancestors: a prefix that many words share is encoded once. The ids of a word are then read off by
stepping back from its end. Nothing is shuffled: each worker encodes the pre-tokens of the batches that it reads.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of pre-tokens that a worker remembers, and a quarter of it of odd chunks; it starts anew beyond.
REMEMBERED = 72_000_000
#: Pairs of neighbours that are remembered.
ASKED = 500_000
#: Text bytes of a batch: words of a larger one share more prefixes.
TRIE_BYTES = 4_000_000
#: Latin letters that are composed, and lower-cased one by one, in any version of Unicode; chunks of these and ASCII.
_LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_SAFE = re.compile(f"[!-~{_LETTERS}]+")
#: Pre-tokens of such chunks in lower case, and what stands between chunks.
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^\\n0-9a-z{_LETTERS}]+|\\n")
#: What they are pre-tokens of: how a vocabulary's file prepares texts.
_PREPARED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: How a vocabulary of bytes writes those that are no printable character.
_BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: Ends a chunk's ids.
_STOP = array("i", [-1]).tobytes()


class TrieEncoder:
    """Encodes pre-tokens (in the byte alphabet of the vocabulary) by a walk over their trie."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = "</w>"):
        self.vocab, self.end = vocab, end
        self.rank = {tuple(m) if not isinstance(m, str) else tuple(m.split(" ")): i for i, m in enumerate(merges)}
        #: Every ending of a token; a token that merging its own symbols gives has the left neighbours asked about.
        self.endings: dict[str, dict[str, bool] | bool] = {}
        for token in vocab:
            plain = token.removesuffix(end)
            mark = token[len(plain) :]
            for start in range(1, len(plain)):
                self.endings.setdefault(plain[start:] + mark, False)
            self.endings[token] = {} if self.merge(self.symbols(token)) == [token] else False
        self.asked = 0

    def symbols(self, token: str) -> list[str]:
        return [*token] if not self.end or not token.endswith(self.end) else [*token[: -len(self.end) - 1], token[-len(self.end) - 1 :]]

    def merge(self, parts: list[str]) -> list[str]:
        """Plain merging, lowest rank and then leftmost first: only for single tokens and pairs of them."""
        rank, none = self.rank, len(self.rank)
        while len(parts) > 1:
            ranks = [rank.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, left: str, right: str) -> bool:
        """Whether merging the symbols of both gives these two tokens; remembered with the right one."""
        self.asked += 1
        if self.asked > ASKED:
            self.asked = 0
            self.endings.update((t, {}) for t, asked in self.endings.items() if asked)
        found = self.merge([*self.symbols(left), *self.symbols(right)]) == [left, right]
        self.endings[right][left] = found
        return found

    def encode(self, words: set[str]) -> dict[str, list[str]]:
        """The tokens of each word. Sorted words walk the trie depth first: the stack holds the path to a node."""
        out: dict[str, list[str]] = {}
        end, endings, neighbours = self.end, self.endings, self.neighbours
        path, last = "", [""]  # last[d]: the last token of the first d symbols
        for word in sorted(words):
            size = len(word)
            shared, most = 0, min(len(path), size - 1)
            if path[:most] == word[:most]:
                shared = most
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            # The end of a word is a symbol of its own, so a word's last node is a leaf.
            for depth in range(shared + 1, size + 1):
                # The one token that ends here and fits what ends before it; shorter ones first, as far as any goes.
                prefix = word if depth == size else word[:depth]
                mark = end if depth == size else ""
                for start in range(depth - 1, -1, -1):
                    token = prefix[start:] + mark
                    asked = endings.get(token)
                    if asked is None:
                        raise ValueError(f"no encoding of {prefix!r}: the vocabulary misses a symbol")
                    if asked is not False:
                        if not start:
                            break
                        left = last[start]
                        fits = asked.get(left)
                        if neighbours(left, token) if fits is None else fits:
                            break
                else:
                    raise ValueError(f"no encoding of {prefix!r}: the vocabulary misses a symbol")
                last.append(token)
            tokens, depth = [token], size + len(end) - len(token)
            while depth:
                tokens.append(left := last[depth])
                depth -= len(left)
            tokens.reverse()
            out[word] = tokens
            last.pop()
            path = word[:-1]
        return out


class Codec:
    """Encoding and decoding of whole texts with one tokenizer file; remembers chunks between white space."""

    def __init__(self, source: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        self.tok = Tokenizer.from_str(source.decode("utf-8"))
        self.tok.no_truncation()
        self.tok.no_padding()
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec.get("decoder"):
            raise ValueError("this codec takes BPE with word ends and no decoder")
        self.trie = TrieEncoder(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        every = [*self.ids.items(), *self.special.items()]
        self.names: list[str | None] = [None] * (max(i for _, i in every) + 1)
        for token, i in every:
            self.names[i] = token
        self.gaps = None in self.names
        self.decimals = [str(i) for i in range(len(self.names))]
        #: Whether pre-tokens of plain chunks are found by an expression of our own: only with this very preparation.
        self.simple = {k: spec.get(k) for k in _PREPARED} == _PREPARED
        #: Ids by pre-token, and by chunk where the library has to split it, as bytes.
        self.words, self.odd = common.Remembered(lambda: REMEMBERED), common.Remembered(lambda: REMEMBERED // 4)

    def _pieces(self, chunk: str) -> list[tuple[str, bool]]:
        """(piece, whether it is a special token) of a chunk; the library normalises and splits it."""
        out = []
        for part in self.split.split(chunk) if self.split and "<|" in chunk else [chunk]:
            if part in self.special:
                out.append((part, True))
            elif part:
                plain = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                out.extend((p, False) for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(plain))
        return out

    def _learn_words(self, words: list[str]) -> None:
        """Ids of new pre-tokens, which make up one trie."""
        ids, names = self.ids, [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES) for w in words]
        coded = self.trie.encode(set(names))
        self.words.learn(words, [array("i", [ids[t] for t in coded[name]]).tobytes() for name in names])

    def _learn_odd(self, chunks: list[str]) -> None:
        """Ids of new chunks that the library has to normalise and split."""
        ids, special, new = self.ids, self.special, [self._pieces(c) for c in chunks]
        coded = self.trie.encode({p for pieces in new for p, marked in pieces if not marked})
        self.odd.learn(chunks, [array("i", [i for p, marked in pieces for i in ([special[p]] if marked else [ids[t] for t in coded[p]])]).tobytes() for pieces in new])

    def _distinct(self, chunks: list[str]):
        """(place of each chunk, ids, number of ids): ids lie one after another in the order of places."""
        self.words.make_room()
        self.odd.make_room()
        plain = [self.simple and (c.isascii() or _SAFE.fullmatch(c) is not None) and c.isprintable() and "<|" not in c for c in chunks]
        joined = "\n".join(compress(chunks, plain))
        known, pieces = self.words, _PLAIN.findall(joined.lower() + "\n") if any(plain) else []
        known["\n"] = _STOP
        if new := [p for p in {*pieces} if p not in known]:
            self._learn_words(new)
        ids = np.frombuffer(b"".join([known[p] for p in pieces]), np.int32)
        stops = np.flatnonzero(ids == -1)
        lengths, ids = np.diff(stops, prepend=-1) - 1, ids[ids != -1]
        plain = np.array(plain, bool)
        place = np.where(plain, np.cumsum(plain), plain.sum() + np.cumsum(~plain)) - 1
        if not plain.all():
            rest = [c for c, p in zip(chunks, plain.tolist(), strict=True) if not p]
            self._learn_odd([c for c in rest if c not in self.odd])
            more = [self.odd[c] for c in rest]
            ids = np.concatenate([ids, np.frombuffer(b"".join(more), np.int32)])
            lengths = np.concatenate([lengths, np.fromiter(map(len, more), np.int64, len(more)) // 4])
        return place, ids, lengths

    def encode_array(self, texts):
        """(ids of all texts, where those of each begin, and where the last ones end) of an Arrow array of texts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        codes, chunks, offsets = common.distinct_parts(pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string())))
        if not chunks:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        place, ids, lengths = self._distinct(chunks)
        ids, ends = common.spread(place[codes], ids, lengths)
        return ids, np.concatenate([[0], ends])[offsets]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        import pyarrow as pa

        ids, bounds = self.encode_array(pa.array(texts, pa.large_string()))
        return [ids[a:b].tolist() for a, b in zip(bounds.tolist(), bounds.tolist()[1:], strict=False)]

    def digests(self, ids, bounds) -> tuple[list[str], list[str]]:
        """SHA-256 of the decimal ids of each text, joined by a space, and of what they decode to."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        for names in (self.decimals, self.names):
            shown = pa.array(["" if n is None else n for n in names], pa.large_string())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), shown.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))
            _, starts, data = joined.buffers()
            at, data = np.frombuffer(starts, np.int64)[: len(joined) + 1].tolist(), memoryview(data or b"")
            out.append([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)])
        return out[0], out[1]

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens, joined by a space; unknown ids are left out."""
        names, most = self.names, len(self.names)
        if ids and 0 <= min(ids) and max(ids) < most and not self.gaps:
            return " ".join([names[i] for i in ids])
        return " ".join([names[i] for i in ids if 0 <= i < most and names[i] is not None])


def codec(source: bytes) -> Codec:
    return common.kept_tool("words", source, Codec)


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids", digests: bool = False, keep_text: bool = True) -> DataFrame:
    """Add the token ids of every text (array of int) to the rows of ``docs``.

    With ``digests`` instead of the ids: n_tokens, ids_sha256 (of decimal ids joined by a space) and decoded_sha256
    (of the ids decoded again). A null text counts as an empty one: no ids. Repeated rows are encoded each; input
    columns named like the added ones are replaced; an empty table gives an empty result.
    """
    import pyarrow as pa

    common.ship(docs.sparkSession)
    source = common.vocabulary(docs.sparkSession, path)
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else [ids_col]
    # The text goes to the workers last; it comes back only where it is kept beside the ids.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in added and not ((digests or not keep_text) and c == text_col)]
    inner = docs.select(*others, F.col(f"`{text_col}`").alias("__text"))
    kept = inner.schema.fields[:-1]
    schema = T.StructType([*kept])
    for name in added:
        schema = schema.add(name, {"n_tokens": "long", ids_col: T.ArrayType(T.IntegerType(), False)}.get(name, "string"), False)

    def run(record_batches):
        with common.worker_memory("words"):
            tool = codec(source.value)
            for batch in common.batches(record_batches, "__text", TRIE_BYTES):
                ids, bounds = tool.encode_array(batch.column(len(kept)))
                if digests:
                    columns = [pa.array(np.diff(bounds), pa.int64()), *(pa.array(x, pa.string()) for x in tool.digests(ids, bounds))]
                else:
                    columns = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), type=pa.list_(pa.field("element", pa.int32(), False)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *columns], names=[f.name for f in schema.fields])

    return inner.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for. Null ids give an empty text; ids outside the vocabulary are left out."""
    import pyarrow as pa

    common.ship(rows.sparkSession)
    source = common.vocabulary(rows.sparkSession, path)
    kept = [c for c in rows.columns if c != text_col]
    inner = rows.select(*(F.col(f"`{c}`") for c in kept))
    at = kept.index(ids_col)
    schema = T.StructType([*inner.schema.fields]).add(text_col, "string", False)

    def run(record_batches):
        with common.worker_memory("words"):
            tool = codec(source.value)
            for batch in record_batches:
                texts = pa.array([tool.decode(ids or []) for ids in batch.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*kept, text_col])

    return inner.mapInArrow(run, schema)


def op6_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return encode(docs, common.tokenizer_path("word_bpe_49k.json"), digests=True)
