"""A cleaning pipeline over documents: toxic documents go, one of each group of near duplicates stays, repeated passages and
secrets are taken out of the texts, and what is left is packed into sequences of tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is stored as Parquet in the
shared folder and read by the next one. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from hydrolens.llm.common import stored, table
from hydrolens.llm.jaccard import one_of_each
from hydrolens.llm.packing import pack
from hydrolens.llm.secrets import find_secrets, redacted
from hydrolens.llm.substrings import dedup_substrings
from hydrolens.llm.toxicity import score, train


def replaced(docs, found, changed, text):
    """The columns of ``docs`` with the text of changed rows replaced and, where there is one, its length kept true."""
    new = F.when(changed, text).otherwise(F.col("text"))
    own = {"text": new, "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[own[c].alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns])


def reject_toxic(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def cut_repeats(spark, docs, sf_dir):
    """Words that repeated passages cover are taken out; texts without any stay as they are."""
    return replaced(docs, dedup_substrings(docs), F.col("n_removed") > 0, F.col("kept_text"))


def mask_secrets(spark, docs, sf_dir):
    """Every secret in a text is replaced by a mark."""
    found = find_secrets(docs)
    text = redacted(F.coalesce(F.col("text"), F.lit("")), F.col("secret_spans"))
    return replaced(docs, found, F.size("secret_spans") > 0, text)


def pack_tokens(spark, docs, sf_dir):
    """Pieces of full sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("secret scans", mask_secrets),
    ("packing", pack_tokens),
]

#: A trained classifier, banded joins and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
