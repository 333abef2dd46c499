"""Token arrays: padding, sentence-end chunking in its four variants, and the byte-trie tokenizer."""

from __future__ import annotations

import ast

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Special ids.
PAD, EOS, IMAGE, STOP = 0, 65535, 65534, 261


def _ints(*values: Column) -> Column:
    return F.array(*values).cast("array<int>")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def left_pad(ids: Column, n: Column | int, pad: int = PAD) -> Column:
    """F50."""
    n = F.lit(n) if isinstance(n, int) else n
    return _let(ids, lambda x: F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(0), n - F.size(x))), x))


def last(ids: Column, n: Column) -> Column:
    """The last n tokens."""
    n = F.least(n, F.size(ids))
    return F.when(n > 0, F.slice(ids, F.size(ids) - n + 1, n)).otherwise(_ints())


def spread(ids: Column, n_eos: Column) -> Column:
    """The tokens in n_eos chunks of equal size (the last ones shorter or empty), each with an end after it."""
    size = F.greatest(F.lit(1), F.ceil(F.size(ids) / n_eos).cast("int"))
    chunk = lambda i: F.slice(ids, i * size + 1, size)
    return F.flatten(F.transform(F.sequence(F.lit(0), n_eos - 1), lambda i: F.concat(chunk(i), _ints(F.lit(EOS)))))


def repeated(ids: Column, n_eos: Column) -> Column:
    """The tokens n_eos times, each with an end after it."""
    return F.flatten(F.array_repeat(F.concat(ids, _ints(F.lit(EOS))), n_eos))


def flags(n_off: Column, n_on: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(False), n_off), F.array_repeat(F.lit(True), n_on))


def eos_pretrain(ids: Column, ctx: int, chunk: int | None = None) -> Column:
    """struct(ids, eos_mask). The last tokens that fit; short texts are repeated before every end."""
    chunk = chunk if chunk and chunk > 0 else ctx
    n_eos = ctx // chunk
    cut = lambda own: F.when(F.size(own) >= chunk, spread(own, F.lit(n_eos))).otherwise(repeated(own, F.lit(n_eos)))
    body = _let(last(ids, F.lit(max(0, ctx - n_eos))), cut)
    return F.struct(left_pad(body, ctx).alias("ids"), flags(F.lit(0), F.lit(n_eos)).alias("eos_mask"))


def eos_sft(ids: Column, ctx: int, chunk: int | None = None) -> Column:
    """struct(ids, eos_mask). Unused ends come first and are masked; an empty text is all masked."""
    chunk = chunk if chunk and chunk > 0 else ctx
    most = -(-ctx // chunk)
    size = F.least(F.size(ids), F.lit(ctx - most))
    wanted = F.greatest(F.lit(1), F.ceil(size / chunk).cast("int"))
    per = F.greatest(F.lit(1), F.ceil(size / wanted).cast("int"))
    n_on = F.ceil(size / per).cast("int")  # chunks that hold a token
    n_off = F.when(size > 0, most - wanted).otherwise(most)
    body = F.concat(F.array_repeat(F.lit(EOS), n_off), F.when(size > 0, _let(last(ids, F.lit(ctx - most)), lambda own: spread(own, n_on))).otherwise(_ints()))
    return F.struct(left_pad(body, ctx).alias("ids"), flags(n_off, n_on).alias("eos_mask"))


def eos_eval(ids: Column, ctx: int, chunk: int, most: int = 8) -> Column:
    """struct(ids, eos_mask), not yet padded. At most `most` contexts; long texts are split into contexts of equal size."""
    n_eos = ctx // chunk
    size = F.least(F.size(ids), F.lit(ctx * most))
    splits = F.greatest(F.lit(1), F.ceil(size / ctx).cast("int"))
    per = F.ceil(size / splits).cast("int")
    is_long = size > ctx - n_eos

    def cut(own: Column) -> Column:
        long = F.flatten(F.transform(F.sequence(F.lit(0), splits - 1), lambda i: _let(F.slice(own, i * per + 1, per), lambda x: spread(x, F.lit(n_eos)))))
        return F.when(size < chunk, repeated(own, F.lit(n_eos))).when(is_long, long).otherwise(spread(own, F.lit(n_eos)))

    body = _let(F.slice(ids, 1, ctx * most), cut)
    return F.struct(body.alias("ids"), flags(F.lit(0), F.when(is_long & (size >= chunk), splits * n_eos).otherwise(F.lit(n_eos))).alias("eos_mask"))


def batch_pad(ids: Column, mask: Column, most_eos: Column, longest: Column) -> Column:
    """ends with mask off until all rows of a batch have as many, then padding on the left."""
    off = F.greatest(F.lit(0), most_eos - F.size(mask))
    body = F.concat(F.array_repeat(F.lit(EOS), off), ids)
    return F.struct(left_pad(body, longest).alias("ids"), F.concat(F.array_repeat(F.lit(False), off), mask).alias("eos_mask"))


def cross_encode(ids: Column, n: int) -> Column:
    """an end if none is there, left padding to n, then the last n."""
    closed = F.when(F.try_element_at(ids, F.lit(-1)) == EOS, ids).otherwise(F.array_append(ids, EOS))
    return last(left_pad(closed, n), F.lit(n))


def eos_mask(ids: Column) -> Column:
    """F63."""
    return F.transform(ids, lambda x: x == EOS)


def windows(ids: Column, size: int) -> Column:
    """Consecutive windows of `size`; none for no tokens."""
    n = F.size(ids)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(ids, i * size + 1, size))).otherwise(
        F.array().cast("array<array<int>>")
    )


@F.pandas_udf(ArrayType(IntegerType()))
def _byte_ids(texts: pd.Series) -> pd.Series:
    """Whole texts as arrays, by numpy: no built-in function lists a string's bytes in linear time."""
    return texts.map(lambda t: np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8).astype(np.int32) + 1)


def byte_ids(text: Column) -> Column:
    """F51 with the byte vocabulary: id = byte + 1; null is empty."""
    return _byte_ids(F.coalesce(text, F.lit("")))


class Vocabulary:
    """Tokens by bytes, greedy longest match. With reserve_zero, id 0 only decodes, as the end of text."""

    def __init__(self, tokens: dict[bytes, int], reserve_zero: bool = False):
        self.ids = dict(tokens)
        self.tokens = {i: b for b, i in tokens.items()}
        if reserve_zero:
            self.tokens[0] = b"<|endoftext|>"
        self.longest = max(map(len, tokens), default=0)

    @staticmethod
    def bytewise(*extra: bytes) -> Vocabulary:
        """Every byte, so that any text can be encoded, and some longer tokens."""
        return Vocabulary({bytes([b]): b + 1 for b in range(256)} | {t: 257 + i for i, t in enumerate(extra)})

    @staticmethod
    def from_lines(lines: list[str], reserve_zero: bool = False) -> Vocabulary:
        """Lines of: id, a literal string or bytes, its length in bytes (checked)."""
        tokens = {}
        for line in lines:
            number, rest = line.split(" ", 1)
            literal, size = rest.rsplit(" ", 1)
            value = ast.literal_eval(literal)
            raw = value.encode("utf-8") if isinstance(value, str) else value
            if len(raw) != int(size):
                raise ValueError(f"token {number}: {len(raw)} bytes, {size} stated")
            tokens[raw] = int(number)
        return Vocabulary(tokens, reserve_zero)

    def encode(self, text: str) -> list[int]:
        raw, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(raw):
            for n in range(min(self.longest, len(raw) - at), 0, -1):
                i = self.ids.get(raw[at : at + n])
                if i is not None:
                    out.append(i)
                    at += n
                    break
            else:
                raise ValueError(f"no token begins with byte {raw[at]}")
        return out

    def decode(self, ids: list[int], errors: str = "replace") -> str:
        return b"".join(self.tokens[i] for i in ids if i in self.tokens).decode("utf-8", errors)


def trie_encode(vocabulary: Vocabulary, add_eos: bool = False):
    """an Arrow function from text to ids; null is empty."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: vocabulary.encode(t or "") + [EOS] * add_eos)

    return encode


def trie_decode(vocabulary: Vocabulary, errors: str = "replace"):
    """an Arrow function from ids to text."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: vocabulary.decode(list(x), errors))

    return decode
