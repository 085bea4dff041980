import pytest

from grainmill.operators.commands import CommandError
from grainmill.operators.ids import ROW_ID
from grainmill.plans import checkpoints
from grainmill.plans.history import Timeline
from grainmill.plans.recipe import Step


def line(spark):
    rows = [(1, " a", "x"), (2, "a", "x"), (3, "a", "x"), (4, None, "y")]
    return Timeline(spark.createDataFrame(rows, f"{ROW_ID} long, v string, w string"))


def test_lineage_goes_on_over_checkpoints(spark, tmp_path):
    first = line(spark)
    first.run("trim", column="v")
    first.run("remove_duplicates")
    first.run("hash", column="w", secret="hidden")
    first.run("delete_column", column="w")
    first.undo()
    kept = checkpoints.checkpoint(first, f"{tmp_path}/1", "t")
    assert sorted(r[ROW_ID] for r in kept.current().collect()) == [1, 4] and kept.position == 0
    kept.run("rename_column", column="v", new_name="u")
    checkpoints.checkpoint(kept, f"{tmp_path}/2", "t1", parent=f"{tmp_path}/1")
    found = checkpoints.lineage(spark, f"{tmp_path}/2").collect()
    assert [(r.generation, r.step, r.source, r.action, r.rows_affected) for r in found] == [(1, 1, "t", "trim", 1), (1, 2, "t", "remove_duplicates", 2), (1, 3, "t", "hash", 2), (2, 1, "t1", "rename_column", None)]
    assert "hidden" not in "".join(r.details for r in found) and all(r.checkpointed_at for r in found)
    assert checkpoints.read(spark, f"{tmp_path}/2").columns == [ROW_ID, "u", "w"]


def test_a_whole_checkpoint_stays(spark, tmp_path):
    path = f"{tmp_path}/c"
    line(spark).current().write.parquet(f"{path}/table")  # left by a writer that was lost
    checkpoints.checkpoint(line(spark), path, "t", counted=False)
    assert checkpoints.lineage(spark, path).count() == 0 and checkpoints.read(spark, path).count() == 4
    with pytest.raises(CommandError):
        checkpoints.checkpoint(line(spark), path, "t")


def test_status_of_steps(spark):
    t = line(spark)
    t.run("trim", column="v")
    t.run("replace", column="v", find="a", to="b", match="exact")
    assert t.status(Step("trim", {"column": "v"})) == "modified_since"
    assert t.status(Step("trim", {"column": "value"}), {"value": "v"}) == "modified_since"
    assert t.status(Step("replace", {"column": "v", "find": "a"})) == "already_applied"  # the command says more than the step
    assert t.status(Step("replace", {"column": "v", "find": "z"})) == "not_applied"
    t.run("delete_row", row_ids=[1])
    assert t.status(Step("replace", {"column": "v", "find": "a"})) == "modified_since"
    t.undo()
    assert t.status(Step("delete_row", {"row_ids": [1]})) == "not_applied"
