"""Rule tables of the memory engine, in natural order."""

TYPE_SCORES = {"guardrail": 1.0, "ruled_out": 0.95, "convention": 0.9, "warning": 0.8, "command": 0.7, "infra": 0.7, "config": 0.7, "decision": 0.6, "bugfix": 0.5, "error_pattern": 0.5, "research": 0.3, "note": 0.2, "idea": 0.2}
ROI_MULTIPLIERS = {"guardrail": 3.0, "ruled_out": 2.5, "convention": 2.5, "warning": 2.0, "decision": 2.0, "error_pattern": 1.8, "command": 1.5, "infra": 1.5, "config": 1.5, "bugfix": 1.2, "research": 1.0, "note": 0.8, "idea": 0.7}
TTL_DAYS = {"command": 60, "research": 90, "note": 60, "idea": 120, "bugfix": 180, "ruled_out": 180}
IMMUNE_TYPES = ("guardrail", "convention", "decision", "user", "feedback")
ZERO_ACCESS_DAYS = {"note": 30, "research": 45, "idea": 60, "bugfix": 90}
PROMOTION_RANK = {"note": 1, "bugfix": 2, "decision": 2, "warning": 3, "convention": 4, "guardrail": 5}
PROMOTIONS = (("note", 5, "convention"), ("note", 10, "guardrail"), ("bugfix", 5, "convention"), ("warning", 5, "guardrail"), ("decision", 3, "convention"))
FTS_STOPWORDS = ("que", "qui", "les", "des", "une", "aux", "pour", "avec", "dans", "sur", "par", "est", "sont", "the", "and", "for", "with", "this", "that", "you", "are", "how", "what", "can", "will", "from")
DAY = 86400
