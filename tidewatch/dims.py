"""Dimension data: companies, keywords, risk categories and phrase lists.

The dimensions are tiny and fixed, so they are offered both as plain Python values (compiled into
literal column expressions) and as DataFrames (for joins, and as the shape of user-supplied
dimensions).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# ---- fixed values: the company dimension (ticker, official name, sector, supplier?, keywords) ----
COMPANIES = [
    ("AAPL", "Apple Inc.", "Technology", False,
     ["apple", "iphone", "ipad", "mac", "macbook", "ios", "app store", "foxconn", "hon hai"]),
    ("GOOGL", "Alphabet Inc.", "Technology", False,
     ["google", "alphabet", "android", "youtube", "gmail", "chrome", "google cloud"]),
    ("MSFT", "Microsoft Corporation", "Technology", False,
     ["microsoft", "windows", "office", "xbox", "azure", "teams", "surface"]),
    ("AMZN", "Amazon.com Inc.", "Technology", False,
     ["amazon", "aws", "prime", "alexa", "whole foods", "kindle"]),
    ("META", "Meta Platforms Inc.", "Technology", False,
     ["meta", "facebook", "instagram", "whatsapp", "oculus", "metaverse"]),
    ("NFLX", "Netflix Inc.", "Technology", False, ["netflix"]),
    ("TSLA", "Tesla Inc.", "Automotive", False,
     ["tesla", "model s", "model 3", "model x", "model y", "cybertruck", "supercharger"]),
    ("GM", "General Motors Company", "Automotive", False,
     ["general motors", "gm", "chevrolet", "cadillac", "buick", "gmc"]),
    ("F", "Ford Motor Company", "Automotive", False, ["ford", "f-150", "mustang", "lincoln"]),
    ("TM", "Toyota Motor Corporation", "Automotive", False,
     ["toyota", "lexus", "prius", "camry", "corolla"]),
    ("TSM", "Taiwan Semiconductor Manufacturing Company", "Semiconductors", True,
     ["tsmc", "taiwan semiconductor"]),
    ("NVDA", "NVIDIA Corporation", "Semiconductors", False, ["nvidia", "geforce", "rtx", "cuda"]),
    ("INTC", "Intel Corporation", "Semiconductors", False, ["intel", "xeon", "core", "pentium"]),
    ("AMD", "Advanced Micro Devices Inc.", "Semiconductors", False,
     ["amd", "ryzen", "radeon", "epyc"]),
    ("QCOM", "QUALCOMM Incorporated", "Semiconductors", False, ["qualcomm", "snapdragon"]),
    ("AVGO", "Broadcom Inc.", "Semiconductors", True, ["broadcom"]),
    ("HON", "Honeywell International Inc.", "Industrial", True, ["honeywell"]),
    ("GE", "General Electric Company", "Industrial", True, ["general electric", "ge"]),
    ("MMM", "3M Company", "Industrial", True, ["3m"]),
    ("CAT", "Caterpillar Inc.", "Industrial", True, ["caterpillar", "heavy machinery"]),
    ("WMT", "Walmart Inc.", "Retail", False, ["walmart", "sam's club"]),
    ("TGT", "Target Corporation", "Retail", False, ["target"]),
    ("HD", "The Home Depot Inc.", "Retail", False, ["home depot"]),
    ("COST", "Costco Wholesale Corporation", "Retail", False, ["costco"]),
    ("XOM", "Exxon Mobil Corporation", "Energy", False, ["exxon", "mobil", "exxon mobil"]),
    ("CVX", "Chevron Corporation", "Energy", False, ["chevron"]),
    ("JPM", "JPMorgan Chase & Co.", "Financial", False, ["jpmorgan", "chase", "jp morgan"]),
    ("BAC", "Bank of America Corporation", "Financial", False, ["bank of america"]),
    ("WFC", "Wells Fargo & Company", "Financial", False, ["wells fargo"]),
    ("JNJ", "Johnson & Johnson", "Healthcare", False, ["johnson & johnson", "j&j"]),
    ("PFE", "Pfizer Inc.", "Healthcare", False, ["pfizer"]),
    ("UNH", "UnitedHealth Group Incorporated", "Healthcare", False,
     ["unitedhealth", "united health"]),
    ("BA", "The Boeing Company", "Aerospace", False, ["boeing", "737", "747", "787"]),
    ("LMT", "Lockheed Martin Corporation", "Aerospace", True, ["lockheed martin", "lockheed"]),
    ("RTX", "Raytheon Technologies Corporation", "Aerospace", True,
     ["raytheon", "pratt whitney"]),
    ("VZ", "Verizon Communications Inc.", "Telecommunications", False, ["verizon"]),
    ("T", "AT&T Inc.", "Telecommunications", False, ["at&t", "att"]),
    ("KO", "The Coca-Cola Company", "Consumer Goods", False, ["coca-cola", "coke", "coca cola"]),
    ("PEP", "PepsiCo Inc.", "Consumer Goods", False,
     ["pepsi", "pepsico", "frito-lay", "gatorade"]),
    ("MCD", "McDonald's Corporation", "Consumer Goods", False, ["mcdonalds", "mcdonald's"]),
    ("BABA", "Alibaba Group Holding Limited", "Technology", False, ["alibaba", "taobao", "tmall"]),
    ("TCEHY", "Tencent Holdings Limited", "Technology", False, ["tencent", "wechat", "qq"]),
]

# fixed value: the first-match dimension also lists "cat" between CAT's two keywords
FIRST_MATCH_EXTRA = ("CAT", "cat", 1)

# fixed values: risk categories (name, risk multiplier, sentiment bias, phrases)
CATEGORIES = [
    ("critical_disruption", 2.0, -0.8,
     ["supply chain disruption", "manufacturing halt", "factory closure",
      "semiconductor shortage", "raw material shortage", "logistics crisis",
      "port congestion", "shipping delay", "supply shortage"]),
    ("operational_issues", 1.5, -0.6,
     ["production delay", "inventory shortage", "supplier issues", "quality control", "recall",
      "compliance violation", "transportation bottleneck", "warehouse capacity"]),
    ("market_concerns", 1.2, -0.4,
     ["demand uncertainty", "price volatility", "market slowdown", "economic headwinds",
      "competition pressure"]),
    ("positive_developments", 0.8, 0.6,
     ["capacity expansion", "new supplier", "automation upgrade", "efficiency improvement",
      "cost reduction", "partnership", "diversification", "resilience building"]),
]

# fixed values: shock phrases
SHOCK_PHRASES = [
    "supply chain disruption", "supply chain collapse", "supply chain crisis",
    "factory closure", "factory shutdown", "manufacturing halt", "production halt",
    "production shutdown", "plant closure",
    "semiconductor shortage", "chip shortage", "raw material shortage", "component shortage",
    "critical shortage", "severe shortage",
    "logistics crisis", "logistics failure", "port congestion", "port closure",
    "shipping crisis", "transportation disruption", "delivery failure",
    "power outage", "infrastructure failure", "system failure", "network outage",
]

# fixed values: routing lists of the tiered scorer
ROUTE_WORDS = ["earnings", "quarterly", "profit", "loss", "revenue", "guidance", "bankruptcy",
               "acquisition", "merger", "ipo", "dividend", "ceo", "cfo", "management", "board",
               "resignation"]
ROUTE_PHRASES = ["supply chain disruption", "factory closure", "semiconductor shortage",
                 "raw material shortage", "logistics crisis", "port congestion",
                 "manufacturing halt", "critical shortage"]
ROUTE_TICKERS = ["AAPL", "MSFT", "GOOGL", "AMZN", "TSLA", "META", "NVDA", "JPM", "JNJ", "V",
                 "PG", "UNH", "HD", "MA"]
ROUTE_LENGTH = 200

# fixed values: headline word lists of the first-match scorer and of the simple scorer
FIRST_MATCH_NEGATIVE = ["halt", "shortage", "delay", "cut", "drop"]
FIRST_MATCH_POSITIVE = ["expand", "beat", "surge", "growth"]
SIMPLE_NEGATIVE = ["halt", "shortage", "delay", "cut"]
SIMPLE_POSITIVE = ["expand", "growth", "success"]
SIMPLE_KEYWORDS = [("tesla", "TSLA"), ("apple", "AAPL"), ("microsoft", "MSFT"),
                   ("amazon", "AMZN"), ("google", "GOOGL")]

# fixed values: model label maps
POLARITY_LABELS = {"positive": 1.0, "negative": -1.0, "neutral": 0.0}
NUMBERED_LABELS = {"LABEL_0": -1.0, "LABEL_1": 0.0, "LABEL_2": 1.0}

# fixed values: histogram bucket bounds in seconds
ENRICH_BUCKETS = [0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0]
PUBLISH_BUCKETS = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0]


def keyword_rows(variant: str = "word") -> list[tuple[str, str, int]]:
    """(keyword, ticker, ord) in dimension order; the first company wins a contested keyword.

    ``variant="first_match"`` gives the list used by substring matching, which has one more entry.
    """
    seen: dict[str, str] = {}
    for ticker, _, _, _, keywords in COMPANIES:
        words = list(keywords)
        if variant == "first_match" and ticker == FIRST_MATCH_EXTRA[0]:
            words.insert(FIRST_MATCH_EXTRA[2], FIRST_MATCH_EXTRA[1])
        for word in words:
            seen.setdefault(word.lower(), ticker)
    return [(word, ticker, i) for i, (word, ticker) in enumerate(seen.items())]


def longest_first(rows: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """Matching order: longer keywords first, dimension order among equals."""
    return sorted(rows, key=lambda r: (-len(r[0]), r[2]))


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small constant table whose size the optimizer knows (so it broadcasts on its own)."""
    schema = StructType.fromDDL(ddl)
    return spark.createDataFrame(
        pa.Table.from_pylist([dict(zip(schema.names, row)) for row in rows],
                             schema=to_arrow_schema(schema)), schema)


def company_dim(spark: SparkSession) -> DataFrame:
    rows = [(t, n, kws, s, sup) for t, n, s, sup, kws in COMPANIES]
    return local_table(spark, rows, "ticker string, official_name string, "
                                    "keywords array<string>, sector string, is_supplier boolean")


def keyword_dim(spark: SparkSession, variant: str = "word") -> DataFrame:
    return local_table(spark, keyword_rows(variant), "keyword string, ticker string, ord int")


def category_dim(spark: SparkSession) -> DataFrame:
    rows = [(i, c, kws, m, b) for i, (c, m, b, kws) in enumerate(CATEGORIES)]
    return local_table(spark, rows, "ord int, category string, keywords array<string>, "
                                    "risk_multiplier double, sentiment_bias double")
