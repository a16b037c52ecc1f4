"""Named seams of a pipeline: ordered steps from table to table, and a registry of functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]

# The seams, in the order in which a table passes them.
SEAMS = ["after_load", "after_preprocess", "after_layout", "after_ocr", "after_chunk", "after_embed", "before_answer", "after_answer", "on_log"]


class Pipeline:
    """Steps at seams; each gets what the one before returned, and a seam without steps is passed as it is."""

    def __init__(self) -> None:
        self.steps: dict[str, list[Step]] = {s: [] for s in SEAMS}

    def at(self, seam: str, step: Step) -> Pipeline:
        if seam not in self.steps:
            raise KeyError(f"no seam {seam}")
        self.steps[seam].append(step)
        return self

    def run(self, df: DataFrame) -> DataFrame:
        for seam in SEAMS:
            for step in self.steps[seam]:
                df = df.transform(step)
        return df


    def manifest(self) -> list[tuple[str, int, str]]:
        """(seam, place, name) of every step, in the order in which a table passes them."""
        return [(seam, i, getattr(step, "__name__", type(step).__name__)) for seam in SEAMS for i, step in enumerate(self.steps[seam])]


class Registry:
    """Functions by name, such as detectors and engines; arguments a function doesn't take are left out."""

    def __init__(self) -> None:
        self.known: dict[str, Callable] = {}

    def add(self, name: str, f: Callable) -> None:
        self.known[name] = f

    def make(self, name: str, **arguments: object) -> object:
        if name not in self.known:
            raise KeyError(f"{name} is none of {sorted(self.known)}")
        import inspect

        takes = inspect.signature(self.known[name]).parameters
        return self.known[name](**{k: v for k, v in arguments.items() if k in takes})

    def status(self) -> dict[str, str]:
        """For each name "ready", or why it can't be used: what its ``probe`` says or raises."""
        found = {}
        for name, f in sorted(self.known.items()):
            try:
                reason = getattr(f, "probe", lambda: None)()
            except Exception as e:  # a probe may fail in any way
                reason = str(e) or type(e).__name__
            found[name] = "ready" if reason is None else str(reason)
        return found


def scored(df: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]], keys: list[str]) -> DataFrame:
    """``df`` with a column for each scorer given from outside; a scorer makes (``keys``, score) of the table, and rows it leaves out have null."""
    for name, f in scorers.items():
        df = df.join(f(df).select(*keys, "score").withColumnRenamed("score", name), keys, "left")
    return df
