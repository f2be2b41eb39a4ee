"""Table layouts. Matrices are flat, row-major ``array<double>`` with their shape beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame

SAMPLES = "session_id string, idx long, ts double, x array<double>"
CHANNELS = "session_id string, pos int, label string"
MARKERS = "session_id string, ts double, code int"
ANNOTATIONS = "subject_id long, idx long, description string"
TASK = "session_id string, pos int, sample_type string"
EPOCHS = (
    "subject_id long, event_id long, label long, sample_weight double, is_background boolean, is_right_hand boolean, is_point boolean, n_channels int, n_times int, sample array<double>"
)
PREDICTIONS = "subject_id long, sample_index long, event_id long, true_label int, predicted_label int, predicted_proba double, sample_weight double"
RESULTS = "type string, prediction int, probability double, processing_time double, ground_truth_labels array<int>, ground_truth_label double"


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself; an error that names what is missing otherwise."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
