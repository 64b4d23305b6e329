"""Fixed values that results depend on."""

# Severity names from mild to grave, and their display classes.
SEVERITY_ORDER = ["low", "medium", "high", "critical"]
SEVERITY_CLASSES = {
    "low": "severity-low",
    "medium": "severity-medium",
    "high": "severity-high",
    "critical": "severity-critical",
}

# Sales multiplier by hour of day.
HOUR_FACTORS = {
    0: 0.3, 1: 0.2, 2: 0.15, 3: 0.1, 4: 0.1, 5: 0.15,
    6: 0.3, 7: 0.5, 8: 0.7, 9: 0.9, 10: 1.0, 11: 1.1,
    12: 1.2, 13: 1.1, 14: 1.0, 15: 1.0, 16: 1.1, 17: 1.2,
    18: 1.3, 19: 1.4, 20: 1.3, 21: 1.1, 22: 0.8, 23: 0.5,
}

# Sales multiplier by weekday, Monday = 0.
WEEKDAY_FACTORS = {0: 0.85, 1: 0.90, 2: 0.95, 3: 1.00, 4: 1.15, 5: 1.30, 6: 1.20}

# Sales multiplier by month.
MONTH_FACTORS = {
    1: 0.85, 2: 0.80, 3: 0.90, 4: 0.95, 5: 1.00, 6: 1.05,
    7: 1.00, 8: 0.95, 9: 1.00, 10: 1.10, 11: 1.30, 12: 1.50,
}

# Advice texts by feature and direction.
ADVICE = [
    ("total_revenue", "higher",
     "Investigate source of revenue spike - potential promotion success or data error"),
    ("total_revenue", "lower",
     "Urgent: Revenue drop detected - check for system issues or market changes"),
    ("total_amount", "higher", "Large transaction detected - verify for fraud or bulk order"),
    ("total_amount", "lower", "Unusually small transaction - may indicate pricing error"),
    ("quantity", "higher", "High volume order - ensure inventory availability"),
    ("quantity", "lower", "Low volume despite normal revenue - check pricing"),
    ("transaction_count", "higher", "Transaction spike - monitor server capacity"),
    ("transaction_count", "lower", "Transaction drop - investigate potential system issues"),
]
ADVICE_NONE = "Monitor this data point for recurring patterns"
SUMMARY_NONE = "Unusual pattern detected across multiple features"

# Titles, messages and actions of single insights; braces hold the figures.
INSIGHT_TEXTS = {
    "revenue_up_action": "Continue strategies driving growth",
    "revenue_down_action": "Investigate causes of revenue decline",
    "region_action": "Investigate factors affecting {region} sales and consider regional promotions.",
    "critical_title": "{critical_count} Critical Anomalies Detected",
    "high_title": "{high_count} High-Priority Anomalies",
    "critical_message": "There are {critical_count} critical anomalies requiring immediate attention. These represent significant deviations from expected patterns.",
    "high_message": "Detected {high_count} high-priority anomalies that should be reviewed.",
    "critical_action": "Review critical anomalies immediately and investigate root causes.",
    "anomaly_region_action": "Investigate operational issues in {region} region.",
    "forecast_up_action": "Prepare for increased demand",
    "forecast_down_action": "Consider promotional activities to boost sales",
    "weekend_title": "Weekend Sales Outperformance",
    "weekday_title": "Weekday Sales Dominance",
    "weekend_message": "Weekend sales average {weekend_text}/day vs {weekday_text}/day on weekdays. Consider weekend-focused campaigns.",
    "weekday_message": "Weekday sales are stronger ({weekday_text}/day) than weekends ({weekend_text}/day).",
    "weekend_action": "Increase weekend staffing and promotional activities.",
    "weekday_action": "Consider weekend promotions to boost off-peak sales.",
}
