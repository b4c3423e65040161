"""Token counts by the whole-token shortcut.

The vocabulary is a sentencepiece BPE model whose pieces never hold a word mark after another character, so no merge
crosses the place before a run of blanks: a text is the concatenation of its pre-tokens (a run of blanks and what follows
up to the next blank), and so are its tokens.  ``lone_tokens`` proves on the driver, before any text is read, which
pre-tokens are one token: it encodes every vocabulary string by itself.  Executors count pre-tokens per batch of texts,
take proven ones as one token each, and give only the rest to the library's merges, each distinct one once.

Null and empty texts have no tokens.  Repeated rows are counted each; columns other than the text are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PRE_TOKEN = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


def lone_tokens(model_file: str) -> frozenset[str]:
    """Pre-tokens (written with blanks, the first one's blank included) that encode alone as one token.

    Raises if a piece of the vocabulary could join two pre-tokens: the shortcut would then be wrong.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
    plain = [(i, p) for i, p in pieces if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    if any(re.search(f"[^{MARK}]{MARK}", p) for _, p in plain):
        raise ValueError("a piece crosses words; pre-tokens can't be counted apart")
    marked = [(i, p) for i, p in plain if p.startswith(MARK)]
    encoded = model.encode([p[1:].replace(MARK, " ") for _, p in marked], num_threads=1)
    lone = {p.replace(MARK, " ") for (i, p), ids in zip(marked, encoded) if ids == [i]}
    if len(model.encode("a ")) == len(model.encode("a")) + 1:
        lone.add(" ")  # the library takes a lone blank for no text
    return frozenset(lone)


def count_tokens(text: str | Column = "text", model_file: str | None = None, cache_size: int = 500_000) -> Column:
    """Tokens of each text, without begin, end or added special tokens.

    ``cache_size`` bounds the counts of merged pre-tokens that a worker remembers; it never changes a result.
    """
    path = model_file or public_tokenizers.path("piece_bpe_32k.model")
    lone = lone_tokens(path)
    known: dict[str, int] = {}
    loaded: list[sentencepiece.SentencePieceProcessor] = []

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(sentencepiece.SentencePieceProcessor(model_file=path))
        out = []
        for value in texts:
            if not value:
                out.append(0)
                continue
            seen = Counter(PRE_TOKEN.findall(f" {value}".replace(MARK, " ")))
            rest = [word for word in seen if word not in lone and word not in known]
            if rest:
                if len(known) > cache_size:
                    known.clear()
                    rest = [word for word in seen if word not in lone]
                for at in range(0, len(rest), 10_000):
                    part = rest[at:at + 10_000]
                    known.update(zip(part, map(len, loaded[0].encode([word[1:] for word in part], num_threads=1))))
            out.append(sum(n if word in lone else n * known[word] for word, n in seen.items()))
        return pd.Series(out, dtype="int64")

    return tokens(F.col(text) if isinstance(text, str) else text)


def token_table(documents: DataFrame, limit: int = 4096, model_file: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), count_tokens("text", model_file).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
