"""Free-text answers cut into their three sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from findrisk.functions.text import strip

# What a heading contains, in lower case, tested in this order.
HEADINGS = {
    "context": ("## i.", "## context", "# context", "**i.", "**context"),
    "impact": ("## ii.", "## impact", "# impact", "**ii.", "**impact"),
    "remedy": ("## iii.", "## remedy", "# remedy", "**iii.", "**remedy"),
}


def _heading(line: Column) -> Column:
    """Name of the section a line opens, null for any other line."""
    lowered = F.lower(line)
    name = F.lit(None).cast("string")
    for section, marks in reversed(list(HEADINGS.items())):
        found = F.lit(False)
        for mark in marks:
            found = found | lowered.contains(mark)
        name = F.when(found, section).otherwise(name)
    return name


def section_responses(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Kept columns plus ``context``, ``impact`` and ``remedy``.

    Heading lines and text before the first heading are dropped; an answer
    without sections is all context. An answer is cut inside its own row, so
    nothing is shuffled.
    """
    marked = df.select(*keep, F.col(text).alias("_text"), F.split(strip(F.col(text)), "\n").alias("_lines"))
    headings = F.filter(
        F.transform("_lines", lambda line, i: F.struct(_heading(line).alias("name"), i.alias("at"))),
        lambda entry: entry["name"].isNotNull(),
    )
    placed = marked.withColumn("_headings", headings).withColumn(
        "_blocks",
        F.transform(
            "_headings",
            lambda entry, i: F.struct(
                entry["name"].alias("name"),
                (entry["at"] + 2).alias("start"),
                (F.coalesce(F.get("_headings", i + 1)["at"], F.size("_lines")) - entry["at"] - 1).alias("length"),
            ),
        ),
    )

    def section(name: str) -> Column:
        blocks = F.filter("_blocks", lambda block: block["name"] == name)
        return F.flatten(F.transform(blocks, lambda block: F.slice("_lines", block["start"], block["length"])))

    names = list(HEADINGS)
    cut = placed.withColumns({f"_{name}": section(name) for name in names})
    empty = F.lit(True)
    for name in names:
        empty = empty & (F.size(f"_{name}") == 0)
    return cut.select(
        *keep,
        *[
            strip(F.when(empty, F.col("_text") if name == "context" else F.lit("")).otherwise(F.array_join(f"_{name}", "\n"))).alias(name)
            for name in names
        ],
    )
