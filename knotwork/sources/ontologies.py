"""Ontologies from Turtle files: a dictionary of elements that nothing changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vocab
from ..operators.graphs import checkpointed
from . import turtle


@dataclass(frozen=True)
class Dictionary:
    """elements (with flags, own domain, range and inverse), kinds (sub, kind, depth), inherited (domain and range), about (labels)."""

    elements: DataFrame
    kinds: DataFrame
    inherited: DataFrame
    about: DataFrame

    def lookup(self, df: DataFrame) -> DataFrame:
        """``df`` (element, ...) with what the dictionary has on each; ``known`` is false where it has nothing."""
        held = self.elements.withColumn("known", F.lit(True))
        return df.join(held, "element", "left").withColumn("known", F.coalesce("known", F.lit(False)))

    def below(self, element: str) -> DataFrame:
        """An element and all below it (element)."""
        return self.kinds.where(F.col("kind") == element).select(F.col("sub").alias("element"))


def load(spark: SparkSession, path: str) -> Dictionary:
    """All ontologies of a path as one dictionary; read once."""
    t = checkpointed(turtle.read(spark, path).drop("_corrupt_record"))
    elements, kinds = checkpointed(vocab.elements(t)), checkpointed(vocab.kinds(t))
    return Dictionary(elements, kinds, vocab.inherited(elements, kinds), vocab.about(t))
