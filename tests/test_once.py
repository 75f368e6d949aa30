"""Values that several columns share are computed once: what the optimised plan names of them."""

import pytest

from sieveworks.plans import catalogue

#: By query: a function of the shared value, and how often the plan may name it.
COSTLY = {
    "edit_records": ("sha2(", 12),
    "construction_records": ("sha2(", 12),
    "missing_oracles": ("from_json(", 3),
    "prompt_messages": ("from_json(", 2),
    "program_dispatch": ("from_json(", 1),
    "task_key_label": ("from_json(", 1),
    "compatibility_folded": ("translate(", 12),
}


@pytest.mark.parametrize("name", sorted(COSTLY))
def test_shared_values_are_computed_once(name, spark, sf_dir):
    text, most = COSTLY[name]
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(text) <= most


@pytest.mark.parametrize("name", ["construction_records", "control_programs", "edit_records", "missing_oracles", "program_dispatch", "prompt_messages", "property_histogram", "task_key_label"])
def test_costly_rows_of_one_file_are_dealt_to_all_tasks(name, spark, sf_dir):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # all that is costly stands above the exchange
    above, below = plan.split("Repartition 4, true")
    assert "Project" in above and not any(f in below for f in ("from_json(", "transform(", "sha2("))
