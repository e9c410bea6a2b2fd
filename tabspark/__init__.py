"""tabspark: profile, clean, train, evaluate, explain and score tables on Spark."""

from tabspark.operators.clean import (clip_outliers, derive, drop_columns, drop_null_target, drop_sparse_columns,
                                      fill_missing)
from tabspark.operators.counting import value_counts
from tabspark.operators.profile import (box_stats, columns_over_missing, corr_matrix, delta, describe, detect_task,
                                        histogram, input_domains, missing_counts, outlier_counts, quality_report,
                                        scatter_grid, scatter_points, summary)
from tabspark.operators.quantiles import quantiles
from tabspark.plans.recipe import Project, Recipe
from tabspark.plans.run import Run, RunSpec, train
from tabspark.plans.train import (evaluate, explain, feature_importance, fit, global_contributions, score,
                                  score_proba, waterfall)
from tabspark.plans.tuning import cross_validate, learning_curve, search_space, tune
from tabspark.sources.models import load_model, save_model
from tabspark.sources.runs import Runs
from tabspark.sources.tables import read_csv, read_parquet, write_csv, write_parquet
from tabspark.streaming.scoring import score_stream, write_scores
