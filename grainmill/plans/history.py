"""Timelines: a source and its commands; undo and redo fold commands from the nearest snapshot before."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.commands import apply
from ..operators.diff import Diff, diff
from ..operators.ids import user_columns
from ..operators.validation import audit, audit_chain
from ..sources.versions import Versions
from .recipe import Step, renamed


#: Snapshots of a timeline at most.
MOST = 10
#: Commands that change which rows there are, and so undo what steps before them said of a column.
ROW_COMMANDS = ("remove_duplicates", "delete_row", "insert_row", "merge")


@dataclass
class Timeline:
    """A source, its commands and the position among them.

    With ``snapshots``, the state after every ``every`` commands is written there under
    its position, ``most`` at most; the one whose neighbours are closest goes first, so those that
    stay are spread over the timeline.  What stands after an undone command goes as
    soon as another command takes its place.
    """

    source: DataFrame
    steps: list[Step] = field(default_factory=list)
    position: int = 0
    snapshots: Versions | None = None
    every: int = 5
    most: int = MOST

    def run(self, command: str, **params) -> DataFrame:
        """Add a command; what was undone is forgotten."""
        step = Step(command, params)
        after = apply(self.at(self.position), command, **params)
        if self.snapshots:
            for n in self.snapshots.numbers():
                if n > self.position:
                    self.snapshots.drop(n)
        self.steps = [*self.steps[: self.position], step]
        self.position += 1
        if self.snapshots and self.position % self.every == 0:
            self.snapshots.write(after, self.position)
            self._evict()
            after = self.snapshots.read(self.position)
        return after

    def _evict(self) -> None:
        kept = self.snapshots.numbers()
        while len(kept) > self.most:
            inner = kept[:-1]  # the newest stays: undo starts there
            gaps = {n: kept[i + 1] - (kept[i - 1] if i else 0) for i, n in enumerate(inner)}
            least = min(inner, key=lambda n: (gaps[n], n))
            self.snapshots.drop(least)
            kept.remove(least)

    def at(self, position: int) -> DataFrame:
        """The table after ``position`` commands, from the nearest snapshot that is not after it."""
        start = (self.snapshots.latest(position) if self.snapshots else None) or 0
        df = self.snapshots.read(start) if start else self.source
        for s in self.steps[start:position]:
            df = apply(df, s.command, **s.params)
        return df

    def current(self) -> DataFrame:
        return self.at(self.position)

    def undo(self) -> DataFrame:
        self.position = max(0, self.position - 1)
        return self.current()

    def redo(self) -> DataFrame:
        self.position = min(len(self.steps), self.position + 1)
        return self.current()

    def details(self, position: int, most: int = 10_000) -> DataFrame:
        """Cells that the command at ``position`` changed, in columns before and after it."""
        before, after = self.at(position - 1), self.at(position)
        both = [c for c in user_columns(before) if c in after.columns]
        return audit(before, after, both, str(position), most)

    def chain_details(self, first: int, last: int, most: int = 10_000) -> DataFrame:
        """What each of the commands ``first`` to ``last`` changed, from one scan; see :func:`audit_chain`."""
        return audit_chain(self.at(first - 1), self.steps[first - 1 : last], first, most)

    def step_diff(self, position: int) -> Diff:
        """The rows that the command at ``position`` added, removed or changed, by row id."""
        return diff(self.at(position - 1), self.at(position))

    def position_diff(self, one: int, other: int) -> dict[str, int]:
        """Rows added and removed and cells changed from the lower position to the higher, counted by row id."""
        low, high = sorted((one, other))
        rows = diff(self.at(low), self.at(high)).with_modified_columns()
        kind = F.col("diff_status")
        cells = F.sum(F.when(kind == "modified", F.size("modified_columns")).otherwise(0))
        r = rows.agg(F.count_if(kind == "added").alias("added_rows"), F.count_if(kind == "removed").alias("removed_rows"), F.coalesce(cells, F.lit(0)).alias("modified_cells")).first()
        return r.asDict()

    def status(self, step: Step, columns: dict[str, str | None] | None = None) -> str:
        """Whether a recipe's step stands among the commands up to the position: ``not_applied``, ``already_applied`` or ``modified_since``.

        A command is the step where it has the step's name and, under the names of ``columns``, all its
        parameters; it may have more of them.  It is modified by a later command on its column, or on any rows as wholes.
        """
        wanted = renamed(step.params, columns or {})
        for i, s in enumerate(self.steps[: self.position]):
            if s.command == step.command and all(s.params.get(k) == v for k, v in wanted.items()):
                column = wanted.get("column")
                later = self.steps[i + 1 : self.position]
                return "modified_since" if any(x.command in ROW_COMMANDS or (column and x.params.get("column") == column) for x in later) else "already_applied"
        return "not_applied"


def latest_changes(changelog: DataFrame) -> DataFrame:
    """The last write of each cell of ``changelog(ts, row_id, column, value)``: by ``ts``, then ``seq`` where there is one, then the value."""
    order = [F.col(c).desc_nulls_last() for c in ("ts", "seq", "value") if c in changelog.columns]
    last = Window.partitionBy("row_id", "column").orderBy(*order)
    return changelog.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def prune(entries: DataFrame, keep: int = 100) -> DataFrame:
    """The newest ``keep`` audit entries of ``entries(entry_id, created_at, …)``."""
    newest = entries.select("entry_id", "created_at").distinct().orderBy(F.col("created_at").desc(), "entry_id").limit(keep).select("entry_id")
    return entries.join(newest, "entry_id", "left_semi")
