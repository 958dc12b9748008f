"""Double-typed output columns per oracle query (static schema metadata of the catalog).

Both engines apply the same final contract rounding to exactly these columns.
Regenerate with tests/gen_oracle_doubles.py after changing a query's schema.
"""

DOUBLE_COLUMNS = {'age_band': [],
 'age_years': ['age_years'],
 'agg_bureau': ['BUREAU_ACTIVE_RATIO', 'BUREAU_DEBT_SUM', 'BUREAU_DEBT_MEAN', 'BUREAU_CREDIT_SUM',
                'BUREAU_CREDIT_MEAN', 'BUREAU_AMT_OVERDUE_SUM', 'BUREAU_DAYS_CREDIT_MEAN'],
 'agg_bureau_balance': [],
 'agg_credit_card': ['CC_BALANCE_MEAN', 'CC_UTILIZATION_MEAN', 'CC_DPD_MEAN'],
 'agg_installments': ['INST_LATE_RATE', 'INST_DPD_MEAN', 'INST_SHORTFALL_MEAN'],
 'agg_pos': ['POS_DPD_MEAN'],
 'agg_previous_apps': ['PREV_APPROVED_RATIO', 'PREV_REFUSED_RATIO', 'PREV_AMT_APPLICATION_MEAN',
                       'PREV_AMT_CREDIT_MEAN', 'PREV_CREDIT_TO_APP_RATIO', 'PREV_DAYS_DECISION_MEAN'],
 'auc_roc': ['auc_roc'],
 'average_precision': ['average_precision'],
 'best_scenario': ['best_net_value', 'best_default_rate', 'reference_net_value'],
 'brier_score': ['brier_score'],
 'bureau_with_balance': ['AMT_CREDIT_SUM_DEBT', 'AMT_CREDIT_SUM', 'AMT_CREDIT_SUM_OVERDUE'],
 'calibration_bins': ['predicted_midpoint', 'actual_default_rate'],
 'calibration_report': ['auc_roc', 'raw_brier', 'calibrated_brier', 'raw_log_loss', 'calibrated_log_loss',
                        'brier_improvement'],
 'class_weights': ['weight'],
 'classification_metrics': ['auc_roc', 'average_precision', 'brier_score', 'log_loss'],
 'clean_feature_name': ['missing_ratio'],
 'column_types': [],
 'confusion_matrix': ['threshold', 'precision', 'recall'],
 'corr_direction': ['corr_with_target'],
 'correlation_top': ['corr_with_target'],
 'data_shape': [],
 'decision_table': ['y_proba', 'threshold_used'],
 'decisions': ['y_proba'],
 'enrich_applications': ['AMT_INCOME_TOTAL', 'AMT_CREDIT', 'BUREAU_ACTIVE_RATIO', 'BUREAU_DEBT_SUM',
                         'BUREAU_DEBT_MEAN', 'BUREAU_CREDIT_SUM', 'BUREAU_CREDIT_MEAN',
                         'BUREAU_AMT_OVERDUE_SUM', 'BUREAU_DAYS_CREDIT_MEAN', 'PREV_APPROVED_RATIO',
                         'PREV_REFUSED_RATIO', 'PREV_AMT_APPLICATION_MEAN', 'PREV_AMT_CREDIT_MEAN',
                         'PREV_CREDIT_TO_APP_RATIO', 'PREV_DAYS_DECISION_MEAN', 'INST_LATE_RATE',
                         'INST_DPD_MEAN', 'INST_SHORTFALL_MEAN', 'POS_DPD_MEAN', 'CC_BALANCE_MEAN',
                         'CC_UTILIZATION_MEAN', 'CC_DPD_MEAN'],
 'f1_score': ['threshold', 'precision', 'recall', 'f1'],
 'fairness_report': ['approval_rate', 'tpr', 'approval_rate_gap', 'tpr_gap'],
 'feature_group': ['missing_ratio'],
 'feature_summary': ['missing_rate', 'mean', 'std', 'p05', 'p50', 'p95', 'top1_rate', 'top2_rate'],
 'feature_summary_categorical': ['missing_rate', 'mean', 'std', 'p05', 'p50', 'p95', 'top1_rate',
                                 'top2_rate'],
 'feature_summary_numeric': ['missing_rate', 'mean', 'std', 'p05', 'p50', 'p95', 'top1_rate', 'top2_rate'],
 'gini': ['gini'],
 'headline_metrics': ['default_rate', 'champion_auc', 'auc_delta_vs_baseline', 'gini', 'ks_statistic'],
 'importance_by_group': ['importance'],
 'importance_group': ['missing_ratio'],
 'importance_rank': ['importance'],
 'impute_median': ['median'],
 'invalid_scores': ['y_proba'],
 'invalid_target_values': [],
 'kpi_overview': ['default_rate', 'avg_missing_rate', 'pct_columns_missing_gt_40'],
 'ks_statistic': ['ks_statistic'],
 'log_loss': ['log_loss'],
 'metrics_compare': ['auc_roc', 'average_precision', 'brier_score', 'log_loss'],
 'missing_severity': ['missing_rate'],
 'missingness': ['missing_ratio'],
 'missingness_by_feature': ['missing_rate'],
 'optimal_threshold': ['threshold', 'approval_rate', 'default_rate_among_approved', 'expected_profit',
                       'expected_loss', 'expected_value'],
 'payment_lateness': [],
 'payment_shortfall': ['shortfall'],
 'population_segments': ['default_rate'],
 'portfolio_projection': ['threshold', 'scale', 'projected_profit', 'projected_loss', 'projected_value'],
 'quantile_bin': ['AMT_CREDIT'],
 'reliability_curve': ['mean_predicted', 'fraction_positive'],
 'risk_band': ['y_proba'],
 'roc_corners': ['threshold', 'fpr', 'tpr'],
 'roc_curve': ['threshold', 'fpr', 'tpr'],
 'run_stamp': ['y_proba'],
 'safe_div': ['credit_to_app'],
 'sample_rows': ['AMT_INCOME_TOTAL', 'AMT_CREDIT'],
 'scenario_results': ['threshold', 'profit_if_good', 'loss_given_default', 'approval_rate', 'default_rate',
                      'expected_profit', 'expected_loss', 'net_value'],
 'score_histogram': ['bin_lo', 'bin_hi'],
 'segment_extremes': ['weighted_default_rate', 'riskiest_rate', 'safest_rate', 'spread'],
 'segment_kpis': ['approval_rate', 'avg_pd', 'estimated_bad_rate', 'observed_default_rate'],
 'segments_age_band': ['default_rate'],
 'segments_category': ['default_rate'],
 'segments_quantile': ['default_rate'],
 'stratified_folds': ['AMT_INCOME_TOTAL', 'AMT_CREDIT'],
 'stratified_sample': ['AMT_INCOME_TOTAL', 'AMT_CREDIT'],
 'stratified_split': ['AMT_INCOME_TOTAL', 'AMT_CREDIT'],
 'target_stats': ['pct'],
 'three_way_split': ['AMT_INCOME_TOTAL', 'AMT_CREDIT'],
 'threshold_sweep': ['threshold', 'approval_rate', 'default_rate_among_approved', 'expected_profit',
                     'expected_loss', 'expected_value'],
 'top_missing_features': ['missing_rate'],
 'utilization': ['utilization'],
 'load_sources': [], 'one_hot': [], 'predictions': ['y_proba'], 'shap_importance': ['mean_abs_shap'], 'shap_values': ['shap'],
 'stratified_folds_null_label': ['AMT_INCOME_TOTAL', 'AMT_CREDIT'], 'stratified_split_null_label': ['AMT_INCOME_TOTAL', 'AMT_CREDIT'],
 'value_vs_optimal': ['threshold', 'approval_rate', 'default_rate_among_approved', 'expected_profit', 'expected_loss', 'expected_value',
                      'delta_vs_optimal']}
