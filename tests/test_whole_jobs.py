"""Registered model queries run their operators' whole jobs: every model, arm, issue, rate and seed of the defaults."""

import inspect
from types import SimpleNamespace

import pytest

from sievestone.catalog import model_checks
from sievestone.operators import inject, models
from sievestone.plans import calibrate, compare

WHOLE = {
    "model_panel": (compare.run_panel, {}), "arm_interaction": (compare.run_panel, {}), "regression_panel": (compare.run_panel, {}),
    "controlled_proof": (compare.controlled_proof, {"models": models.CLASSIFIERS, "rate": 0.1}), "regression_proof": (compare.controlled_proof, {"models": models.REGRESSORS, "rate": 0.1}),
    "gated_label_filter": (compare.gated_label_filter, {}), "tuned_repair_choice": (compare.select_repair, {"models": models.CLASSIFIERS, "arms": compare.SINGLE_ARMS, "seed": 42, "trees": 50, "folds": 5}),
    "impact_runs": (compare.impact_runs, {"models": models.CLASSIFIERS, "issues": tuple(inject.INJECTORS), "rates": inject.RATES, "seeds": (42, 43, 44)}),
    "calibration_evidence": (calibrate.run_calibration, {}), "regression_calibration_runs": (calibrate.run_calibration, {}), "full_audit_with_target": (model_checks.audit, {})}


class Called(Exception):
    pass


@pytest.mark.parametrize("name", WHOLE)
def test_whole_job(monkeypatch, name):
    function, own = WHOLE[name]
    signature = inspect.signature(function)

    def called(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Called(bound.arguments)

    table = SimpleNamespace(frame=None)
    for part in ("labelled", "amounts", "cut_lineage"):
        monkeypatch.setattr(model_checks, part, lambda *a: None)
    for part in ("inject_outliers", "inject_labels", "inject_all"):
        monkeypatch.setattr(inject, part, lambda *a: table)
    if function is not model_checks.audit:
        monkeypatch.setattr(model_checks, "audit", lambda *a, **b: None)
    monkeypatch.setattr(compare if function.__module__ == compare.__name__ else model_checks, function.__name__, called)
    with pytest.raises(Called) as found:
        model_checks.QUERIES[name](None, "")
    given = found.value.args[0]
    defaults = {k: p.default for k, p in signature.parameters.items() if p.default is not inspect.Parameter.empty and k not in ("task", "target", "detectors")}
    assert {k: given[k] for k in defaults | own} == defaults | own
