"""Dataset records: bucket labels, subset filters, projections of construction and edit rows, scorer rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import keys, programs, scoring

# Properties that can be computed, in program order.
DESCRIPTORS = ("MW", "LogP", "QED", "TPSA", "HBD", "HBA", "RB")
# Properties shared by both modes, those of edits only, and the sizes of replayed programs.
SHARED_PROPERTIES = ("MW", "LogP", "QED", "HBA", "RB")
EDIT_ONLY_PROPERTIES = ("SA", "GSK3B", "DRD2")
REPLAY_SIZES = (2, 3)
# Names and version in a record.
DATASET, VERSION = "MolProgramInstruct-Balanced", "1.0"
CONSTRUCTION_SIZES, EDIT_SIZES, TARGET_SIZES = (2, 3, 4, 5, 6, 7), (1, 2, 3, 4, 5, 6, 7), (5, 6, 7)
SCORED_DIRECTIONS = ("increase", "decrease", "preserve")


def size_label(size: Column) -> Column:
    """``3p`` for three properties."""
    return F.concat(size.cast("string"), F.lit("p"))


def bucket(mode: Column, size: Column, task: Column, sizes: Sequence[int] = CONSTRUCTION_SIZES, by: str = "benchmark_task", missing: str | None = "") -> Column:
    """``de_novo:{n}p`` or ``edit:{task}`` (by ``property_count``: ``edit:{n}p``); ``missing`` for rows of no bucket."""
    if by not in ("benchmark_task", "property_count"):
        raise ValueError(f"unsupported edit grouping: {by}")
    edit = F.when(size.isin(*EDIT_SIZES), size_label(size)) if by == "property_count" else F.when(task.isin(*programs.REGISTERED_TASKS), task)
    own = F.when((mode == "de_novo") & size.isin(*sizes), F.concat(F.lit("de_novo:"), size_label(size))).when(mode == "edit", F.concat(F.lit("edit:"), edit))
    return F.coalesce(own, F.lit(missing).cast("string"))


def bucket_names(by: str = "benchmark_task", sizes: Sequence[int] = CONSTRUCTION_SIZES) -> list[str]:
    """All buckets of a grouping."""
    edits = [f"{n}p" for n in EDIT_SIZES] if by == "property_count" else sorted(programs.REGISTERED_TASKS)
    return [f"de_novo:{n}p" for n in sizes] + [f"edit:{x}" for x in edits]


def shared_only(properties: Column, size: Column, mode: Column) -> Column:
    """The size of a construction program all of whose properties are shared, if it is replayed; else null."""
    inside = (F.size(properties) > 0) & (F.size(F.array_except(properties, F.array(*map(F.lit, SHARED_PROPERTIES)))) == 0)
    return F.when((mode == "de_novo") & size.isin(*REPLAY_SIZES) & inside, size)


def is_edit_only(properties: Column, mode: Column) -> Column:
    """Whether an edit names a property that construction never does."""
    return F.coalesce((mode == "edit") & F.arrays_overlap(properties, F.array(*map(F.lit, EDIT_ONLY_PROPERTIES))), F.lit(False))


def edit_only_tasks() -> list[str]:
    """Registered tasks that are not shared."""
    return sorted(set(programs.REGISTERED_TASKS) - set(programs.SHARED_TASKS))


def program_of(mode: Column, instructions: Column, controls: Column) -> Column:
    """The program by mode: edits declare instructions, construction declares wide controls."""
    return F.when(mode == "edit", instructions).otherwise(controls)


def chosen_size(seed: int, material: Column, least: int, most: Column) -> Column:
    """A program size from a hash: ``least`` and up, ``most`` different ones."""
    digest = keys.rank16(keys.sha(F.concat(F.lit(f"{seed}:count:"), material)))
    number = F.conv(digest, 16, 10).cast("decimal(20,0)")
    return (F.lit(least) + (number % most.cast("decimal(20,0)"))).cast("int")


def construction_program(rank: Column, values: Column, seed: int, subset, size: Column | None = None) -> Column:
    """The program of a construction record: properties chosen by hash, with their values as goals."""
    size = chosen_size(seed, rank, 2, F.lit(6)) if size is None else size
    chosen = programs.once(F.concat(F.lit(f"{seed}:"), rank), lambda m: subset(F.array(*map(F.lit, DESCRIPTORS)), m, size))
    return programs.once(values, lambda v: F.transform(chosen, lambda p: programs.condition(p, None, F.element_at(v, p))))


def construction_record(target: Column, rank: Column, values: Column, target_hash: Column, source_id: Column, seed: int, system: str, subset, size: Column | None = None, program: Column | None = None) -> list[Column]:
    """The columns of a construction record.

    ``values`` maps descriptors to numbers; ``subset(items, material, size)``
    chooses properties by hash and puts them in program order. ``program`` is a column
    that holds ``construction_program`` already, so that it is not computed for each column.
    """
    program = construction_program(rank, values, seed, subset, size) if program is None else program
    size = chosen_size(seed, rank, 2, F.lit(6)) if size is None else size
    source = F.lit(programs.EMPTY_SOURCE)
    return [
        F.lit(DATASET).alias("dataset"), F.lit(VERSION).alias("release_version"), keys.short_id("mpi4m:de_novo", target_hash).alias("example_id"), F.lit("de_novo").alias("task_mode"),
        source.alias("source_smiles"), target.alias("target_smiles"), F.lit("").alias("source_hash"), target_hash.alias("target_hash"), program.alias("condition_program"),
        programs.program_hash(program).alias("condition_hash"), programs.task_label(program).alias("task_key"), size.alias("property_count"), programs.messages(source, program, system, target).alias("messages"),
        F.struct(F.lit("PubChem").alias("source_dataset"), source_id.alias("source_record_id"), values.alias("descriptor_values"), F.lit("deterministic_property_subset").alias("program_view")).alias("provenance"),
        rank.alias("selection_rank"),
    ]


def edit_material(row_id: Column, source: Column, target: Column, seed: int) -> Column:
    """What an edit record's choices are hashed from."""
    return F.concat_ws(":", F.lit(str(seed)), row_id, source, target)


def edit_program(row_id: Column, source: Column, target: Column, active: Column, directions: Column, seed: int, subset, size: Column | None = None) -> Column:
    """The program of an edit record: active properties chosen by hash; raises where one has no direction."""
    size = (lambda m, a: chosen_size(seed, m, 1, F.least(F.lit(7), F.size(a)))) if size is None else (lambda m, a, s=size: s)
    chosen = programs.once(F.struct(edit_material(row_id, source, target, seed).alias("m"), active.alias("a")), lambda x: subset(x["a"], x["m"], size(x["m"], x["a"])))
    made = programs.once(directions, lambda ways: F.transform(chosen, lambda p: programs.condition(p, programs.direction_of(F.try_element_at(ways, p)))))
    refused = F.raise_error(F.lit("active edit property without direction")).cast(programs.PROGRAM)
    return programs.once(made, lambda x: F.when(F.exists(x, lambda c: c["direction"] == ""), refused).otherwise(x))


def edit_record(row_id: Column, source: Column, target: Column, active: Column, directions: Column, similarity: Column, instruction: Column, tasks: Column, seed: int, system: str, subset, size: Column | None = None, program: Column | None = None) -> list[Column]:
    """The columns of an edit record; raises where an active property has no direction.

    ``active`` holds the properties that may be named, ``directions`` maps them to directions.
    ``program`` is a column that holds ``edit_program`` already, so that it is not computed for each column.
    """
    program = edit_program(row_id, source, target, active, directions, seed, subset, size) if program is None else program
    material = edit_material(row_id, source, target, seed)
    size = chosen_size(seed, material, 1, F.least(F.lit(7), F.size(active))) if size is None else size
    return [
        F.lit(DATASET).alias("dataset"), F.lit(VERSION).alias("release_version"), keys.short_id("mpi4m:edit", keys.pair_key(source, target)).alias("example_id"), F.lit("edit").alias("task_mode"),
        source.alias("source_smiles"), target.alias("target_smiles"), keys.sha(source).alias("source_hash"), keys.sha(target).alias("target_hash"), keys.pair_key(source, target).alias("pair_hash"),
        similarity.cast("double").alias("source_tanimoto"), program.alias("condition_program"), programs.program_hash(program).alias("condition_hash"), programs.task_label(program).alias("task_key"),
        size.alias("property_count"), programs.messages(source, program, system, target).alias("messages"),
        F.struct(
            F.lit("MolEdit-Instruct").alias("source_dataset"), row_id.alias("source_record_id"), instruction.alias("original_instruction"), tasks.alias("original_instruction_tasks"),
            active.alias("verified_descriptor_properties"), F.lit("target_delta_verified_property_subset").alias("program_view"),
        ).alias("provenance"),
        keys.sha(material).alias("selection_rank"),
    ]


def scorer_row(source: Column, mode: Column, program: Column) -> Column:
    """The wide row of a program as a map of texts; raises where no property is supported."""
    known = F.filter(program, lambda c: c["property"].isin(*programs.PROPERTIES))
    one = lambda name, value: F.struct(name.alias("key"), value.alias("value"))
    directed = F.filter(known, lambda c: c["direction"].isin(*SCORED_DIRECTIONS))
    items = F.concat(
        F.array(one(F.lit("source_smiles"), F.when(source == programs.EMPTY_SOURCE, "").otherwise(F.coalesce(source, F.lit("")))), one(F.lit("task_mode"), mode)),
        F.transform(known, lambda c: one(F.concat(c["property"], F.lit("_active")), F.lit("True"))),
        F.transform(directed, lambda c: one(F.concat(c["property"], F.lit("_direction")), c["direction"])),
        F.transform(F.filter(known, lambda c: c["around"].isNotNull()), lambda c: one(F.concat(F.lit("target_"), c["property"]), programs.number_text(c["around"]))),
        F.array(one(F.lit("condition_properties"), F.array_join(F.transform(known, lambda c: c["property"]), ","))),
        F.when(F.size(directed) > 0, F.array(one(F.lit("instruction_tasks"), F.to_json(F.transform(directed, lambda c: F.struct(c["property"].alias("property"), c["direction"].alias("direction"))))))).otherwise(F.array().cast("array<struct<key:string,value:string>>")),
    )
    return F.when(F.coalesce(F.size(known), F.lit(0)) < 1, F.raise_error(F.lit("no supported property")).cast("map<string,string>")).otherwise(F.map_from_entries(items))


def reward(mode: Column, soft: Column, hard: Column, editing: str = "hard_boundary") -> Column:
    """The reward that training reads: edits by ``hard_boundary`` or ``soft``, construction always soft."""
    if editing not in ("hard_boundary", "soft"):
        raise ValueError(f"unsupported editing reward mode: {editing}")
    return F.when(mode == "edit", hard).otherwise(soft) if editing == "hard_boundary" else soft


def source_feasible(valid: Column, copy: Column, similarity: Column) -> Column:
    """Whether an answer is valid, no copy and near enough to its source."""
    return F.coalesce(valid & ~copy & (similarity >= scoring.STRICT), F.lit(False))
