"""Schemas of the stored tables."""

from __future__ import annotations

# Names and types of the tables a catalog keeps. Index columns of ``series`` are
# whatever the imported layers have, all double.
DATASETS = (
    "dataset_key string, title string, geom_type string, min_date date, max_date date, "
    "source_key string, source_title string, boundary_key string, boundary_title string, metadata string"
)
FEATURES = (
    "dataset_key string, feature_id string, name string, props map<string,string>, geometry string, "
    "minx double, miny double, maxx double, maxy double, min_date date, max_date date"
)
TREND_STATS = (
    "dataset_key string, index_name string, feature_id string, tau double, p_value double, sen_slope double, "
    "trend string, trend_category string, trend_label_en string, trend_label_fa string, trend_symbol string"
)
MODELS = (
    "model_key string, method_name string, source_key string, index_name string, input_window int, horizon int, "
    "status string, artifact_path string, feature_columns array<string>, training_params map<string,string>, "
    "summary_metrics map<string,double>, trained_at timestamp"
)
DATASET_MODELS = (
    "dataset_key string, index_name string, method_name string, model_key string, issue_date date, "
    "forecast_min_date date, forecast_max_date date"
)
MODEL_VERSIONS = (
    "version_key string, model_key string, method_name string, artifact_path string, trained_at timestamp, "
    "feature_columns array<string>, training_params map<string,string>, summary_metrics map<string,double>"
)
INTERVAL = "struct<label:string,lower:double,upper:double>"
FORECASTS = (
    "dataset_key string, index_name string, method_name string, feature_id string, issue_date date, "
    f"target_date date, lead_month int, value double, lower double, upper double, intervals map<string,{INTERVAL}>"
)
EVALUATION = (
    "dataset_key string, index_name string, method_name string, lead_month int, mae double, rmse double, "
    "bias double, r2 double, correlation double, drought_class_accuracy double, sample_count bigint"
)
FEEDBACK = (
    "dataset_key string, index_name string, method_name string, model_key string, feature_id string, "
    "issue_date date, target_date date, lead_month int, predicted_value double, actual_value double, "
    "error double, absolute_error double, squared_error double"
)

SERIES_KEY = ("dataset_key", "feature_id", "date")
FEATURE_KEY = ("dataset_key", "feature_id")
TREND_KEY = ("dataset_key", "index_name", "feature_id")
FORECAST_KEY = ("dataset_key", "index_name", "method_name", "feature_id", "target_date")
EVALUATION_KEY = ("dataset_key", "index_name", "method_name", "lead_month")
METHOD_KEY = ("dataset_key", "index_name", "method_name")
FEEDBACK_KEY = ("dataset_key", "index_name", "method_name", "feature_id", "issue_date", "target_date")
