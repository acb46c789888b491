"""Speech-recognition evaluation analytics on PySpark.

The public names below are imported on first use, so that workers that need one module don't load all.
"""

from importlib import import_module

__version__ = "0.1.0"

_API = {
    "earshot.functions.dsp": ("ChannelConfig", "apply_channel", "standard_conditions", "degrade"),
    "earshot.functions.text": ("NormalizerConfig", "normalize"),
    "earshot.operators.align": ("word_errors", "char_errors", "error_counts", "score", "corpus_wer"),
    "earshot.operators.aggregate": ("pooled", "slices", "slice_pivot", "headline", "failure_mode", "error_histogram", "heat_cells"),
    "earshot.operators.bootstrap": ("bootstrap_native", "bootstrap_exact", "bootstrap_ci"),
    "earshot.plans.planner": ("BudgetExceeded", "run_benchmark", "plan_grid", "cost_rollup", "budget_cut"),
    "earshot.plans.report": ("build_report",),
    "earshot.sources.audio": ("read_audio",),
    "earshot.sources.manifest": ("read_manifest", "write_manifest", "read_results", "write_results", "conditions_table", "select_conditions"),
    "earshot.sources.samples": ("sample_corpus", "write_corpus"),
    "earshot.streaming.live": ("live_wer", "start_live_wer"),
}
_HOME = {name: module for module, names in _API.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(import_module(_HOME[name]), name)
    raise AttributeError(name)
