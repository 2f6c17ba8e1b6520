"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice over a text has an edge for every vocabulary piece (or byte-fallback character) between two positions. The
pass keeps, for each position of a window as long as the longest piece, the surviving path that ends there, as the id of
its last piece. When all surviving paths of the window lead back through one boundary, the ids before it are committed
and forgotten, so the pass holds the window and the ids not yet agreed on, not the text.

No piece of most models has the white space escape after another character, so all paths meet before each escape. What
stands between two such boundaries is a stretch, and ids are committed at its end, too. Texts are fed in blocks; the
pass runs over each stretch (long ones are committed window by window inside), and a worker remembers the ids of the
stretches it has seen, so that equal ones share one run.

For a unigram model a path's value is the sum of its piece scores and the best path survives. For a merge (BPE) model a
path survives if each neighbouring pair of pieces is one that the merges themselves would leave side by side; there is
exactly one such path to each position, and it is the model's own encoding, so the ids equal the library's.

The model's file gives pieces, scores and type. Texts are encoded with the model's dummy prefix and white space escape and
no other normalisation (models whose normaliser has a rule table are refused). Decoding joins pieces and bytes, turns
the escape back and drops the dummy prefix; bytes that are no UTF-8 become U+FFFD.

Defined cases: null text counts as empty and gives no ids; a literal escape character (U+2581) in a text decodes to a
space, as in the library, so that decoding does not give the text back; repeated rows give a row each; a null id stays
null; an empty table gives an empty result; texts may be of any length (the pass is bounded, a row's text and ids are
whole); other columns pass through, whatever their names, but for those that are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from lodestar.llm.common import hold, map_arrow, sub_batches, table

SPACE = "▁"
BOUNDARY = re.compile(f"[^{SPACE}]{SPACE}")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model file
HEAD = 7  # characters over which texts that begin alike share their steps
PAIR = (2,)  # lengths to try, longest first, for a tail in which no longer piece ends
MEMO = 600_000  # stretches whose ids a worker keeps, some 300 MB with pairs and beginnings; memos start anew beyond that
BLOCK = 1 << 16  # characters of a text that are fed at a time


class Model:
    def __init__(self, path: str, memo: int = MEMO):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("this model normalises text; only the white space escape is supported")
        self.prefix = spec.add_dummy_prefix
        self.merges = proto.trainer_spec.model_type == 2
        self.pieces = [p.piece for p in proto.pieces]
        self.score = [p.score for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.unk = self.kind.index(UNKNOWN)
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.kind[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        #: What an id shows by itself; bytes outside ASCII don't, they need their neighbours.
        self.alone = [p if k not in (UNKNOWN, CONTROL, BYTE) else " ⁇ " if k == UNKNOWN else chr(self.byte_of[i]) if k == BYTE else "" for i, (p, k) in enumerate(zip(self.pieces, self.kind, strict=True))]
        self.high = frozenset(i for i, b in self.byte_of.items() if b >= 0x80)
        ids = {p: i for i, p in enumerate(self.pieces) if self.kind[i] == NORMAL}
        self.rank = ids
        self.ids = {p: i for p, i in ids.items() if len(p) == 1 or not self.merges or self._merge(list(p)) == [p]}
        self.own = {p: p for p in self.ids}  # one string object a piece, however often paths hold it
        self.longest = max(map(len, self.ids), default=1)
        #: For each tail of three characters, the lengths of the pieces that end in it, longest first.
        tails: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 2:
                tails.setdefault(piece[-3:], set()).add(len(piece))
        self.tails = {k: (*sorted(v, reverse=True), 2) for k, v in tails.items()}
        self.crosses = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.most = memo
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.heads: dict[str, tuple[str, ...]] = {}
        self.low = min(self.score) - 10.0

    def _merge(self, parts: list[str]) -> list[str]:
        """What the merges leave of a short list of parts."""
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.rank.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether the merges leave a and b side by side."""
        key = (a, b)
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            found = self.pairs[key] = self._merge([*a, *b]) == [a, b]
        return found

    def units(self, piece: str) -> tuple[int, ...]:
        if (i := self.ids.get(piece)) is not None:
            return (i,)
        if self.byte:
            return tuple(self.byte[b] for b in piece.encode("utf-8", "surrogatepass"))
        return (self.unk,)

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        stream, out = Stream(self), []
        for at in range(0, len(text), BLOCK):
            out += stream.feed(text[at : at + BLOCK], at + BLOCK >= len(text))
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of the stretch of one escape and a word."""
        ids = self.memo.get(word)
        if ids is None:
            ids = tuple(Window(self).all(SPACE + word))
            if len(word) <= 64:
                if len(self.memo) >= self.most:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        if self.high.isdisjoint(ids):
            return self._shown("".join(map(self.alone.__getitem__, ids)))
        out, pending = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(_utf8(bytes(pending)))
                pending.clear()
            if self.kind[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kind[i] != CONTROL:
                out.append(self.pieces[i])
        if pending:
            out.append(_utf8(bytes(pending)))
        return self._shown("".join(out))

    def _shown(self, text: str) -> str:
        text = text.replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _utf8(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


class Stream:
    """One text, block by block. feed() gives the ids committed so far."""

    def __init__(self, model: Model):
        self.m = model
        self.begun = False
        self.tail = ""  # from the start of the last stretch on
        self.window: Window | None = None  # of a stretch of which a part is committed already
        self.before = ""  # the last character that the window has seen

    def feed(self, block: str, last: bool) -> list[int]:
        """last: the text ends with this block."""
        m = self.m
        block = block.replace(" ", SPACE)
        if block and not self.begun:
            self.begun = True
            block = SPACE + block if m.prefix else block
        out: list[int] = []
        text, self.tail = self.tail + block, ""
        if self.window and text:
            found = None if m.crosses else BOUNDARY.search(self.before + text)
            end = found.start() if found else len(text)
            out += self.window.feed(text[:end])
            self.before, text = text[-1], text[end:]
            if text or last:
                out += self.window.close()
                self.window = None
            if not text:
                return out
        end = len(text) if last and not m.crosses else 0 if m.crosses else len(text[: text.rfind(SPACE) + 1].rstrip(SPACE))
        out += self._stretches(text[:end])
        text = text[end:]
        if len(text) > 4 * m.longest or (m.crosses and text):
            self.window, self.before = Window(m), text[-1]
            out += self.window.feed(text)
            if last:
                out += self.window.close()
        else:
            self.tail = text
        return out

    def _stretches(self, text: str) -> list[int]:
        """Ids of whole stretches."""
        if not text:
            return []
        m = self.m
        words = text.split(SPACE)
        if words[0] or "" in words[1:]:
            return self._spaced(words)
        # One escape before each word: the memo is by what follows it.
        parts = list(map(m.memo.get, words[1:]))
        if None in parts:
            parts = [m.word(w) if ids is None else ids for w, ids in zip(words[1:], parts, strict=True)]
        return list(chain.from_iterable(parts))

    def _spaced(self, words: list[str]) -> list[int]:
        """The same where runs of escapes, or none, stand before a word."""
        m = self.m
        out = Window(m).all(words[0]) if words[0] else []
        gap = 0
        for w in words[1:]:
            gap += 1
            if w:
                out += m.word(w) if gap == 1 else Window(m).all(SPACE * gap + w)
                gap = 0
        return out + Window(m).all(SPACE * gap) if gap else out


class Window:
    """The pass itself, character by character: feed() gives the ids committed so far, close() the rest."""

    def __init__(self, model: Model):
        self.m = model
        self.text = ""  # from the last committed boundary on
        self.last: list[str] = [""]  # the last piece of the path that survives at each position of text
        self.value: list[float] = [0.0]

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        m = self.m
        most = 4 * m.longest  # what is not agreed on is looked at again after every so many characters
        for at in range(0, len(chars), most):
            part = chars[at : at + most]
            if m.merges:
                if not self.text and not self.last[0] and len(part) > HEAD:
                    self.last = self._head(part[:HEAD])
                self.text += part
                self._survivors(self.text, self.last)
            else:
                known = len(self.text)
                self.text += part
                for i in range(known + 1, len(self.text) + 1):
                    self._step(i)
            if len(self.text) > most:
                out += self._commit()
        return out

    def close(self) -> list[int]:
        units, ids = self.m.units, self.m.ids
        out: list[int] = []
        i = len(self.text)
        while i:
            piece = self.last[i]
            k = ids.get(piece)
            if k is None:
                out += units(piece)[::-1]
            else:
                out.append(k)
            i -= len(piece)
        return out[::-1]

    def all(self, text: str) -> list[int]:
        return self.feed(text) + self.close()

    def _head(self, head: str) -> list[str]:
        """What survives over the first characters. It depends on them alone, so stretches that begin alike share it."""
        m = self.m
        known = m.heads.get(head)
        if known is None:
            if len(m.heads) >= m.most // 4:
                m.heads.clear()
            known = m.heads[head] = tuple(self._survivors(head, [""]))
        return list(known)

    def _survivors(self, text: str, last: list[str]) -> list[str]:
        """last, up to the end of text."""
        m = self.m
        own, pairs, fits, tails = m.own.get, m.pairs, m.fits, m.tails.get
        put = last.append
        for i in range(len(last), len(text) + 1):
            found = text[i - 1]
            found = own(found, found)
            for n in tails(text[i - 3 : i], PAIR) if i > 2 else PAIR[: i - 1]:
                if n <= i:
                    piece = own(text[i - n : i])
                    if piece is not None:
                        before = last[i - n]
                        fit = pairs.get((before, piece)) if before else True
                        if fit or (fit is None and fits(before, piece)):
                            found = piece
                            break
            put(found)
        return last

    def _step(self, i: int) -> None:
        """The last piece of the best path to position i, by scores."""
        m, text, last = self.m, self.text, self.last
        ids = m.ids
        best, found = self.value[i - 1] + (m.score[ids[text[i - 1]]] if text[i - 1] in ids else m.low), text[i - 1]
        for j in range(max(0, i - m.longest), i - 1):
            piece = text[j:i]
            if piece in ids and self.value[j] + m.score[ids[piece]] > best:
                best, found = self.value[j] + m.score[ids[piece]], piece
        last.append(found)
        self.value.append(best)

    def _path(self, end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(self.last[end])
            end -= len(self.last[end])
        return out[::-1]

    def _commit(self) -> list[int]:
        """Ids up to the last boundary that the paths to all positions of the window share."""
        n, keep = len(self.text), self.m.longest
        at = {n - k for k in range(keep)}
        while len(at) > 1:
            top = max(at)
            at.remove(top)
            at.add(top - len(self.last[top]))
        shared = at.pop()
        if shared <= 0:
            return []
        out = [k for p in self._path(shared) for k in self.m.units(p)]
        # The piece before the boundary stays known: it decides which pieces may follow.
        before = self.last[shared]
        self.text, self.last = self.text[shared:], [before, *self.last[shared + 1 :]]
        if not self.m.merges:
            self.value = [v - self.value[shared] for v in self.value[shared:]]
        return out


@lru_cache(maxsize=1)
def model(path: str, memo: int = MEMO) -> Model:
    return Model(path, memo)


def encode(df: DataFrame, path: str, *, text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """df with ids array<int>, decoded string (of those ids) and exact (decoding gives the text back) added, in place of
    columns so named. path: a model file, readable on executors; memo: stretches that a worker remembers."""
    df = df.drop("ids", "decoded", "exact")
    out = StructType([*df.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType()), StructField("exact", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("sentence_pieces", model.cache_clear)
        m = model(path, memo)
        for batch in sub_batches(batches, text_col, 1 << 20):
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            ids = [m.encode(x) for x in texts]
            decoded = [m.decode(x) for x in ids]
            same = [a == b for a, b in zip(texts, decoded, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(same)], [f.name for f in out.fields])

    return map_arrow(df, run, out)


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("exact").alias("round_trip"))
