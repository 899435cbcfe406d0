"""Schemas of the bitemporal store, the panels and the prediction frame, as DDL."""

PROVIDERS = "id bigint, name string, base_url string, meta string, created_at timestamp"
DATASETS = "id bigint, provider_id bigint, key string, title string, description string, meta string, created_at timestamp"
SERIES = "id bigint, dataset_id bigint, key string, country string, frequency string, transform string, unit string, name string, meta string, created_at timestamp"
RELEASES = "id bigint, dataset_id bigint, release_time timestamp, downloaded_at timestamp, vintage_at timestamp, description string, raw_path string, content_hash string, meta string, created_at timestamp"
OBSERVATIONS = "id bigint, series_id bigint, period_date date, observed_at timestamp, value double, release_id bigint, meta string, created_at timestamp"
INGESTION_LOG = "id bigint, dataset_id bigint, run_time timestamp, status string, rows_inserted int, rows_failed int, details string"
LONG_PANEL = "period_date date, series_id string, value double, provider string"
PREDICTIONS = (
    "Forecast_Origin date, Target_Date date, Model string, Prediction_Type string, Actual double, Predicted double,"
    " n_raw_features int, n_trans_features int, n_sel_features int, n_model_used_features int"
)

#: Spelling of a frequency -> its code. (fixed values)
FREQUENCY_ALIASES = {
    "D": "D", "DAILY": "D", "B": "D",
    "W": "W", "WEEKLY": "W",
    "M": "M", "MONTHLY": "M", "MS": "M", "ME": "M",
    "Q": "Q", "QUARTERLY": "Q", "QS": "Q", "QE": "Q",
    "A": "A", "ANNUAL": "A", "Y": "A", "YEARLY": "A",
}
