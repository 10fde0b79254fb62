"""Fixed values.

Everything in this module is a fixed value that results depend on: keyword
lists, phrase patterns, weights, thresholds and message texts.
"""

# --- fixed values: providers, in fallback order -----------------------------
PROVIDERS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workable"]

# --- fixed values: posting filters ------------------------------------------
TARGET_KEYWORDS = ["data engineer", "data analyst", "data scientist"]
REMOTE_US_TOKENS = ["us", "united states", "america"]
US_STATES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut",
    "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa",
    "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan",
    "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire",
    "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio",
    "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota",
    "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia",
    "wisconsin", "wyoming", "washington d.c.", "washington dc", "dc",
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia",
    "ks", "ky", "la", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv", "nh", "nj",
    "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt",
    "va", "wa", "wv", "wi", "wy",
]
ACTIVE_DAYS = 14

# --- fixed values: employer names and filings -------------------------------
LEGAL_WORDS = [
    "inc", "incorporated", "llc", "corp", "corporation", "ltd", "limited", "lp", "llp", "plc",
    "co", "company", "holdings", "group", "services", "technologies", "technology",
    "solutions", "systems", "international", "global", "us", "usa",
]
APPROVED_STATUSES = ["Certified", "Certified-Expired"]
DENIED_STATUSES = ["Denied"]
RECENT_YEARS = 2
PERM_NEW_HEADER = "EMP_BUSINESS_NAME"
PERM_OLD_COLUMNS = {
    "company_name": "EMPLOYER_NAME",
    "state": "EMPLOYER_STATE_PROVINCE",
    "naics": "NAICS_CODE",
    "fein": None,
}
PERM_NEW_COLUMNS = {
    "company_name": "EMP_BUSINESS_NAME",
    "state": "EMP_STATE",
    "naics": "EMP_NAICS",
    "fein": "EMP_FEIN",
}
PERM_COMMON_COLUMNS = ["CASE_STATUS", "DECISION_DATE", "JOB_TITLE"]
USCIS_NAME = "Employer (Petitioner) Name"
USCIS_YEAR = "Fiscal Year"
USCIS_KINDS = [
    "New Employment", "Continuation", "Change with Same Employer", "New Concurrent",
    "Change of Employer", "Amended",
]

# --- fixed values: matching and scoring weights ------------------------------
W_SEMANTIC, W_SKILL, W_ROLE, W_LOCATION = 0.50, 0.30, 0.10, 0.10
SENIORITY_PENALTY, OFF_TARGET_PENALTY = 0.08, 0.15
TITLE_LEVELS = [(5, ["principal"]), (4, ["staff"]), (3, ["senior", "lead"]), (1, ["junior", "intern"])]
TITLE_LEVEL_DEFAULT = 2
W_INT_MATCH, W_INT_VISA, W_INT_RECENCY = 0.40, 0.35, 0.25
W_DOM_MATCH, W_DOM_RECENCY = 0.70, 0.30
UNKNOWN_EMPLOYER_BASE = 0.40
CONFIDENCE_FLOOR, CONFIDENCE_CEIL = 0.05, 0.95
VOLUME_BANDS = [(200, 0.85), (100, 0.78), (50, 0.68), (20, 0.56), (5, 0.44), (1, 0.35)]
VOLUME_NONE = 0.30
TREND_ADJUSTMENT = {
    "increasing": 0.10, "stable": 0.0, "decreasing": -0.05, "decreasing_sharply": -0.15,
    "insufficient_data": 0.0,
}
FRESHNESS_STEPS = [(1, 1.0), (2, 0.75), (3, 0.5), (4, 0.25)]
FRESHNESS_OLD = 0.1
RECENCY_STEPS = [(3, 1.00), (7, 0.85), (14, 0.70), (30, 0.50), (60, 0.30)]
RECENCY_OLD, RECENCY_UNKNOWN = 0.10, 0.50
LIKELY_SPONSOR_CONFIDENCE = 0.65

# --- fixed values: sponsorship phrases in posting text -----------------------
POSITIVE_STRONG = [
    r"will\s+sponsor",
    r"visa\s+sponsorship\s+(is\s+|will\s+be\s+|)provided",
    r"sponsorship\s+(is\s+|will\s+be\s+)?available",
    r"h[\-\s]?1[\-\s]?b\s+sponsor",
    r"able\s+to\s+sponsor",
    r"provide[sd]?\s+sponsorship",
    r"sponsor\s+work\s+(visa|authorization|permit)",
    r"open\s+to\s+(visa\s+)?sponsoring",
    r"we\s+(do\s+|will\s+)?sponsor",
    r"sponsorship\s+for\s+(this\s+)?role",
    r"sponsor\s+h[\-\s]?1[\-\s]?b",
    r"support\s+(visa|h[\-\s]?1[\-\s]?b)\s+transfer",
]
POSITIVE_WEAK = [
    r"open\s+to\s+sponsorship",
    r"sponsorship\s+considered",
    r"international\s+candidates\s+welcome",
    r"relocation\s+(and\s+|or\s+)?visa",
]
NEGATIVE_STRONG = [
    r"no\s+(visa\s+)?sponsorship",
    r"not\s+(able|eligible)\s+to\s+sponsor",
    r"cannot\s+sponsor",
    r"unable\s+to\s+sponsor",
    r"sponsorship\s+(is\s+)?not\s+available",
    r"does\s+not\s+(offer\s+|provide\s+|)sponsor",
    r"without\s+(the\s+need\s+(of|for)\s+)?sponsorship",
    r"must\s+be\s+(a\s+)?u\.?s\.?\s+citizen",
    r"u\.?s\.?\s+citizens?\s+only",
    r"must\s+be\s+(legally\s+)?authorized\s+to\s+work\s+in\s+the\s+u\.?s\.?",
    r"no\s+work\s+visa",
    r"(not\s+)?require.*sponsorship\s+to\s+work",
]
NEGATIVE_WEAK = [
    r"must\s+be\s+authorized\s+to\s+work",
    r"authorized\s+to\s+work\s+in\s+the\s+(us|united\s+states)",
    r"work\s+authorization\s+required",
    r"eligible\s+to\s+work\s+in\s+the\s+u\.?s\.?\s+without",
]
# Every phrase above contains at least one of these words.
SIGNAL_WORDS = ["sponsor", "visa", "transfer", "international", "citizen", "authoriz", "eligible"]
# Negated forms that the positive list would otherwise claim (negation_guard).
NEGATION_GUARD = [
    r"not\s+(able|eligible)\s+to\s+sponsor",
    r"unable\s+to\s+sponsor",
    r"does\s+not\s+(offer\s+|provide\s+|)sponsor",
]
SIGNAL_DELTAS = {
    "positive": 0.30, "negative": -0.40, "likely_positive": 0.15, "likely_negative": -0.20,
    "unknown": 0.0,
}

# --- fixed values: role keywords for title matching --------------------------
ROLE_KEYWORDS = {
    "Data Engineer": ["data engineer", "data engineering"],
    "Data Scientist": ["data scientist", "data science"],
    "Data Analyst": ["data analyst"],
    "Analytics Engineer": ["analytics engineer"],
    "ML Engineer": ["machine learning engineer", "ml engineer"],
    "Software Engineer": ["software engineer"],
}

# --- fixed values: skills taxonomy -------------------------------------------
SKILLS_TAXONOMY = {
    "languages": [
        "Python", "SQL", "R", "Java", "Scala", "Go", "Bash", "Shell", "C++", "C#", "JavaScript",
        "TypeScript", "Ruby", "Rust", "Julia", "MATLAB", "SAS", "Perl", "Swift", "Kotlin",
    ],
    "data_processing": [
        "Apache Spark", "PySpark", "Spark", "Hadoop", "HDFS", "MapReduce", "Apache Kafka",
        "Kafka", "Apache Flink", "Flink", "Apache Airflow", "Airflow", "dbt", "Dagster",
        "Prefect", "Luigi", "Pandas", "NumPy", "Polars", "Dask", "Ray", "ETL", "ELT",
        "Data Pipeline", "Data Warehouse", "Data Lake", "Data Lakehouse", "Delta Lake",
        "Apache Iceberg", "Iceberg", "Apache Hudi",
    ],
    "ml_ai": [
        "Machine Learning", "Deep Learning", "NLP", "Natural Language Processing",
        "Computer Vision", "Reinforcement Learning", "TensorFlow", "PyTorch", "Keras",
        "scikit-learn", "XGBoost", "LightGBM", "CatBoost", "Hugging Face", "Transformers",
        "BERT", "MLflow", "Kubeflow", "SageMaker", "Vertex AI", "Feature Engineering",
        "Model Training", "Model Deployment", "A/B Testing", "Statistical Analysis",
        "Time Series",
    ],
    "databases": [
        "PostgreSQL", "MySQL", "SQLite", "Oracle", "SQL Server", "MongoDB", "Cassandra",
        "DynamoDB", "Redis", "Elasticsearch", "Neo4j", "ClickHouse", "Druid", "Presto", "Trino",
        "Hive", "Snowflake", "BigQuery", "Redshift", "Azure Synapse", "Databricks",
    ],
    "cloud": [
        "AWS", "Amazon Web Services", "GCP", "Google Cloud", "Azure", "S3", "EC2", "Lambda",
        "RDS", "EMR", "CloudFormation", "Cloud Storage", "Cloud Run", "Pub/Sub", "Dataflow",
        "Dataproc",
    ],
    "visualization": [
        "Tableau", "Power BI", "Looker", "Metabase", "Grafana", "Matplotlib", "Seaborn",
        "Plotly", "D3.js", "Superset",
    ],
    "devops_infra": [
        "Docker", "Kubernetes", "Terraform", "Ansible", "Helm", "Git", "GitHub", "GitLab",
        "CI/CD", "Jenkins", "GitHub Actions", "Linux", "Unix", "REST API", "GraphQL",
        "Microservices",
    ],
    "analytics": [
        "Data Analysis", "Business Intelligence", "BI", "Reporting", "Dashboard", "KPI",
        "Excel", "Google Sheets", "Statistical Modeling", "Regression", "Hypothesis Testing",
        "Cohort Analysis", "Product Analytics",
    ],
}
ALL_SKILLS = [skill for group in SKILLS_TAXONOMY.values() for skill in group]
# Matched case-sensitively and only between non-letters.
SHORT_SKILLS = {"R", "Go", "C", "SAS", "BI", "AWS", "GCP"}

ROLE_SIGNALS = {
    "Data Engineer": [
        "Spark", "PySpark", "Airflow", "dbt", "Kafka", "ETL", "ELT", "Data Pipeline",
        "Data Warehouse", "Data Lake", "Hadoop", "Flink", "Dagster", "Delta Lake", "Redshift",
        "BigQuery", "Snowflake", "Databricks", "Python", "SQL", "Scala",
    ],
    "Data Scientist": [
        "Machine Learning", "Deep Learning", "TensorFlow", "PyTorch", "scikit-learn", "XGBoost",
        "NLP", "Computer Vision", "Statistical Analysis", "Feature Engineering", "A/B Testing",
        "Python", "R",
    ],
    "Data Analyst": [
        "SQL", "Tableau", "Power BI", "Looker", "Excel", "Dashboard", "KPI", "Reporting",
        "Business Intelligence", "Data Analysis", "Python", "Statistical Modeling",
    ],
    "Analytics Engineer": [
        "dbt", "SQL", "Data Warehouse", "Snowflake", "BigQuery", "Redshift", "Databricks",
        "Looker", "ETL", "ELT",
    ],
    "ML Engineer": [
        "MLflow", "Kubeflow", "SageMaker", "Vertex AI", "Docker", "Kubernetes",
        "Model Deployment", "TensorFlow", "PyTorch", "Python", "Machine Learning", "CI/CD",
    ],
}

# --- fixed values: résumé patterns, in the order they are tried --------------
DEGREES = [
    (r"\b(ph\.?d\.?|doctor(?:ate)?)\b", "PhD"),
    (r"\b(m\.?s\.?|master(?:\'?s)?|m\.?eng\.?)\b", "Master's"),
    (r"\b(b\.?s\.?|b\.?e\.?|bachelor(?:\'?s)?|b\.?tech\.?)\b", "Bachelor's"),
]
FIELDS = [
    (r"computer science", "Computer Science"),
    (r"data science", "Data Science"),
    (r"information system", "Information Systems"),
    (r"software engineering", "Software Engineering"),
    (r"electrical engineering", "Electrical Engineering"),
    (r"mathematics|math\b", "Mathematics"),
    (r"statistics", "Statistics"),
    (r"business analytics", "Business Analytics"),
    (r"machine learning", "Machine Learning"),
]
UNIVERSITY = r"\b(university|institute of technology|college)\b"
UNIVERSITY_CHARS = 120
EXPERIENCE = r"(\d+)\+?\s*(?:years?|yrs?)(?:\s+of)?\s+(?:professional\s+)?experience"
DATE_RANGE = r"(20\d{2}|19\d{2})\s*[-–—to]+\s*(20\d{2}|present|current|now)"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
JOB_TITLES = [
    r"(?:senior\s+)?data\s+engineer(?:ing)?",
    r"(?:senior\s+)?data\s+scientist",
    r"(?:senior\s+)?data\s+analyst",
    r"analytics\s+engineer",
    r"(?:machine\s+learning|ml)\s+engineer",
    r"software\s+engineer",
    r"platform\s+engineer",
    r"backend\s+engineer",
    r"data\s+architect",
]
#: Letters that every match of the pattern holds in lower case; without i, k and s, which other characters match too.
JOB_TITLE_LETTERS = [
    ["data", "neer"], ["data", "ent"], ["data", "analy"], ["analyt", "neer"], ["neer"], ["oftware", "neer"],
    ["platform", "neer"], ["end", "neer"], ["data", "arch"],
]
INDUSTRIES = {
    "Fintech": ["fintech", "payment", "banking", "trading", "lending"],
    "Healthtech": ["healthcare", "medical", "clinical", "pharma", "biotech"],
    "E-commerce": ["e-commerce", "ecommerce", "retail", "marketplace"],
    "SaaS": ["saas", "b2b software"],
    "Data/AI": ["data platform", "machine learning platform"],
}
SENIORITY = [
    ("Principal", ["principal", "distinguished"]),
    ("Staff", ["staff"]),
    ("Senior", ["senior", "sr.", "lead", "manager"]),
    ("Mid", ["mid-level", " ii ", " iii "]),
    ("Entry", ["junior", "jr.", "associate", "entry", "intern"]),
]
SENIORITY_LEVELS = ["Entry", "Mid", "Senior", "Staff", "Principal"]
PRESENT_YEAR = 2026
MAX_EXPERIENCE = 40

# --- fixed values: message texts ---------------------------------------------
CONTRADICTION_NOTES = {
    "no_history": "Contradiction: JD offers sponsorship but company has no PERM history — verify independently.",
    "strong_history": "Contradiction: JD discourages sponsorship but company has strong PERM record — may be role-specific.",
    "dropped": "Caution: JD implies sponsorship but PERM filings have dropped sharply.",
    "increasing": "Note: JD discourages sponsorship but PERM filings are increasing — check current policy.",
}
FIT_LABELS = [(0.70, "Strong match"), (0.50, "Good match"), (0.35, "Moderate match")]
FIT_WEAK = "Weak match"
LIBRARY_SIGNAL_TEXT = {
    "positive": "Job description explicitly mentions visa sponsorship is available.",
    "likely_positive": "Job description suggests openness to international candidates.",
    "negative": "Job description explicitly states no visa sponsorship.",
    "likely_negative": "Job description may require existing work authorization.",
    "unknown": "Job description does not mention visa sponsorship.",
}
LIBRARY_TREND_TEXT = {
    "increasing": "Sponsorship filings are trending upward.",
    "stable": "Sponsorship filing volume is stable.",
    "decreasing": "Sponsorship filings have declined recently.",
    "decreasing_sharply": "Sponsorship filings have dropped sharply — proceed with caution.",
    "insufficient_data": "Insufficient data to determine sponsorship trend.",
}
AUDIT_SIGNAL_TEXT = {
    "positive": "JD explicitly states visa sponsorship is available.",
    "likely_positive": "JD suggests openness to international candidates.",
    "negative": "JD explicitly states no visa sponsorship.",
    "likely_negative": "JD may require existing work authorization.",
    "unknown": "JD does not mention visa sponsorship.",
}
AUDIT_TREND_TEXT = {
    "increasing": "Sponsorship filings trending upward.",
    "stable": "Sponsorship volume is stable.",
    "decreasing": "Sponsorship filings have declined recently.",
    "decreasing_sharply": "Sponsorship filings dropped sharply — verify.",
    "insufficient_data": "Insufficient data for trend.",
}
