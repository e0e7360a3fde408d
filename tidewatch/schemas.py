"""Record schemas, as DDL strings."""

NEWS_REQUEST = "headline string, url string, published string, full_text string"
NEWS = "news_id string, headline string, url string, published string, full_text string"
NEWS_REQUIRED = ("news_id", "headline", "url", "published")
MENTION = "ticker string, role string, sentiment double"
ENRICHMENT = ("news_id string, "
              "companies array<struct<ticker: string, role: string, sentiment: double>>")
MENTION_EVENT = ("news_id string, event_ts timestamp, ticker string, role string, "
                 "sentiment double")
SHOCK_EVENT = ("news_id string, event_ts timestamp, ticker string, sentiment double, "
               "headline string")
FEATURES = ("ticker string, window_end timestamp, neg_news_count_5m int, pos_news_count_5m int, "
            "sentiment_score_5m double, risk_score_5m double")
SHOCK_FEATURES = ("ticker string, window_end timestamp, shock_count_5m int, "
                  "worst_sentiment_5m double, risk_score_5m double, "
                  "shock_headlines array<string>")
ALERT_HISTORY = ("ticker string, risk_score decimal(6,3), threshold decimal(6,3), "
                 "severity string, window_end timestamp, triggered_at timestamp, "
                 "notification_sent boolean, notification_sent_at timestamp, "
                 "notification_error string, suppressed boolean, suppression_reason string, "
                 "alert_message string")
STORE = "key string, value string, ingest_ts timestamp, expires_at timestamp"
