"""Writers of records, attacks and result relations. All of them write distributed and commit whole."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_attacks(df: DataFrame, path: str, by_attack: bool = True) -> None:
    """A folder for each attack, or one for all."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("attack") if by_attack else writer).json(path)


def write_results(relations: dict[str, DataFrame], path: str) -> None:
    """Each relation of an evaluation (summary, curves, groups, predictions ...) under its name."""
    for name, df in relations.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
