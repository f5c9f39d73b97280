"""Fixed values of the record-validation rules.

The numbers, words and patterns below decide results, so they are stated
plainly here and nowhere else.  Everything that uses them is configurable.
"""

from __future__ import annotations

# -- fixed values: sources and their weights ---------------------------------

CHECK_REGISTRY = "npi_check"
CHECK_ADDRESS = "google_places"
CHECK_DOCUMENT = "ocr_processing"
CHECK_LICENSE = "state_board_check"
CHECK_ENRICHMENT = "enrichment_lookup"

CHECK_ORDER = [CHECK_REGISTRY, CHECK_ADDRESS, CHECK_DOCUMENT, CHECK_LICENSE, CHECK_ENRICHMENT]

CHECK_WEIGHTS = {
    CHECK_REGISTRY: 0.4,
    CHECK_ADDRESS: 0.25,
    CHECK_LICENSE: 0.15,
    CHECK_ENRICHMENT: 0.2,
}
RULE_SOURCE_WEIGHTS = {
    "npi": 0.4,
    "google_places": 0.25,
    "hospital_website": 0.2,
    "state_board": 0.15,
}
DEFAULT_SOURCE_WEIGHT = 0.1

# -- fixed values: field weights ---------------------------------------------

RULE_FIELD_WEIGHTS = {
    "license_number": 0.25,
    "given_name": 0.20,
    "family_name": 0.20,
    "phone_primary": 0.15,
    "email": 0.10,
    "address_street": 0.10,
}
MERGE_FIELD_WEIGHTS = {
    "npi_number": 0.25,
    "given_name": 0.20,
    "family_name": 0.20,
    "license_number": 0.15,
    "phone_primary": 0.10,
    "email": 0.10,
}
DEFAULT_FIELD_WEIGHT = 0.05

# -- fixed values: confidences a successful check assigns ---------------------

REGISTRY_CONFIDENCE = {
    "npi_number": 0.95,
    "given_name": 0.90,
    "family_name": 0.90,
    "primary_taxonomy": 0.85,
    "practice_name": 0.80,
}
ADDRESS_CONFIDENCE = {
    "address_street": 0.90,
    "place_id": 0.95,
    "latitude": 0.90,
    "longitude": 0.90,
}
LICENSE_CONFIDENCE = {
    "license_number": 0.95,
    "license_state": 0.90,
    "license_status": 0.95,
    "issue_date": 0.80,
    "expiry_date": 0.80,
}
ENRICHMENT_CONFIDENCE = {
    "phone_primary": 0.85,
    "email": 0.80,
    "affiliations": 0.70,
    "services_offered": 0.65,
}
CHECK_CONFIDENCE = {
    CHECK_REGISTRY: 0.90,
    CHECK_ADDRESS: 0.90,
    CHECK_LICENSE: 0.90,
    CHECK_ENRICHMENT: 0.75,
}

# -- fixed values: report thresholds, fields and texts -------------------------

CRITICAL_MERGE_FIELDS = ["npi_number", "given_name", "family_name", "license_number"]
CRITICAL_FIELDS = ["npi_number", "given_name", "family_name", "license_number", "license_state"]
IMPORTANT_FIELDS = ["phone_primary", "email", "address_street", "primary_taxonomy"]
HIGH, MEDIUM, LOW = 0.8, 0.6, 0.4

FLAG_RECOMMENDATIONS = {
    "missing_critical_field": "Provide missing critical fields (NPI, name, license) for complete validation",
    "low_confidence": "Review and improve data quality for low-confidence fields",
    "validation_failed": "Investigate and resolve failed validation tasks",
    "npi_not_found": "Verify NPI number or check if provider is registered in NPI Registry",
    "invalid_phone": "Format phone number in E.164 format (+1XXXXXXXXXX)",
    "invalid_email": "Provide valid email address with proper format",
    "address_not_found": "Verify address format and completeness",
    "ocr_failed": "Improve document quality or try alternative OCR processing",
}
INSIGHT_RECOMMENDATIONS = {
    "missing_critical_fields": "Complete missing critical fields to enable full validation",
    "failed_validations": "Retry failed validation tasks or check data sources",
}
DEFAULT_RECOMMENDATION = "Data validation completed successfully"

# -- fixed values: format patterns ---------------------------------------------

EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
FIELD_PATTERNS = {
    "npi_number": r"^[0-9]{10}$",
    "phone_primary": r"^\+?[0-9\s\-\(\)\.]+$",
    "email": EMAIL_PATTERN,
    "license_number": r"^[A-Za-z0-9\-]+$",
    "address_zip": r"^[0-9]{5}(-[0-9]{4})?$",
}
HEADER_ALIASES = {
    "provider_id": ["provider_id", "id", "provider_identifier"],
    "given_name": ["given_name", "first_name", "firstname", "fname"],
    "family_name": ["family_name", "last_name", "lastname", "lname"],
    "npi_number": ["npi_number", "npi", "national_provider_identifier"],
    "phone_primary": ["phone_primary", "phone", "telephone", "tel"],
    "email": ["email", "e_mail", "email_address"],
    "address_street": ["address_street", "address", "street_address", "addr"],
    "address_city": ["address_city", "city"],
    "address_state": ["address_state", "state", "state_code"],
    "address_zip": ["address_zip", "zip", "zip_code", "postal_code"],
    "license_number": ["license_number", "license", "license_no", "lic_no"],
    "license_state": ["license_state", "lic_state", "license_state_code"],
    "primary_taxonomy": ["primary_taxonomy", "taxonomy", "specialty", "speciality"],
    "practice_name": ["practice_name", "practice", "organization", "org_name"],
    "document_path": ["document_path", "document", "file_path", "pdf_path"],
}
MAX_LENGTHS = {
    "given_name": 100,
    "family_name": 100,
    "primary_taxonomy": 200,
    "practice_name": 200,
    "address_street": 255,
    "address_city": 100,
    "address_zip": 10,
    "place_id": 255,
    "phone_primary": 20,
    "phone_alt": 20,
    "license_number": 50,
    "license_status": 20,
}

# -- fixed values: scalar look-ups -----------------------------------------------

GEOMETRY_CONFIDENCE = {
    "ROOFTOP": 0.95,
    "RANGE_INTERPOLATED": 0.85,
    "GEOMETRIC_CENTER": 0.75,
    "APPROXIMATE": 0.60,
}
DEFAULT_GEOMETRY_CONFIDENCE = 0.50
ADDRESS_TYPES = ["street_address", "premise", "subpremise", "route"]

SOURCE_RELIABILITY = {
    "npi": "high",
    "google_places": "high",
    "hospital_website": "medium",
    "state_board": "high",
    "enrichment": "medium",
    "manual": "low",
    "ocr": "medium",
}

# trust per (source, mode, field); the registry modes differ for three fields
#: Domains that take mail, where a rule is given none of its own.
MAIL_DOMAINS = ["gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com"]

TRUST_SCORES = {
    ("npi_registry", "npi_search"): {
        "npi_number": 0.98, "given_name": 0.95, "family_name": 0.95,
        "primary_taxonomy": 0.92, "practice_name": 0.80,
        "address_street": 0.85, "address_city": 0.85, "address_state": 0.85, "address_zip": 0.85,
        "phone_primary": 0.70, "email": 0.60,
        "license_number": 0.0, "license_state": 0.0, "license_status": 0.0,
    },
    ("npi_registry", "name_search"): {
        "npi_number": 0.90, "given_name": 0.85, "family_name": 0.85,
        "primary_taxonomy": 0.92, "practice_name": 0.80,
        "address_street": 0.85, "address_city": 0.85, "address_state": 0.85, "address_zip": 0.85,
        "phone_primary": 0.70, "email": 0.60,
        "license_number": 0.0, "license_state": 0.0, "license_status": 0.0,
    },
    ("google_places", "geocoding"): {
        "place_id": 0.95, "latitude": 0.90, "longitude": 0.90, "formatted_address": 0.90,
        "address_street": 0.85, "address_city": 0.88, "address_state": 0.88, "address_zip": 0.85,
    },
    ("state_board", "verification"): {
        "license_number": 0.95, "license_status": 0.80, "provider_name": 0.75,
        "issue_date": 0.70, "expiry_date": 0.70, "specialty": 0.65, "board_actions": 0.90,
    },
}

# words, in order of precedence, that name a license status or a board action
LICENSE_STATUS_WORDS = [
    ("active", ["active", "current", "valid", "good"]),
    ("expired", ["expired", "expire", "invalid"]),
    ("suspended", ["suspended", "suspend"]),
    ("revoked", ["revoked", "revoke", "cancelled"]),
    ("pending", ["pending"]),
    ("probation", ["probation", "probationary"]),
]
DEFAULT_LICENSE_STATUS = "inactive"
ACTION_WORDS = [
    ("suspension", ["suspension", "suspend"]),
    ("revocation", ["revocation", "revoke"]),
    ("probation", ["probation", "probationary"]),
    ("fine", ["fine", "penalty"]),
    ("warning", ["warning", "reprimand"]),
]
DATE_PATTERNS = [
    r"\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b",
    r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b",
    r"\b([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})\b",
]
HTML_SELECTORS = {
    "provider_name": ".provider-name, .physician-name, .name",
    "license_status": ".status, .license-status, .current-status",
    "issue_date": ".issue-date, .issued, .date-issued",
    "expiry_date": ".expiry-date, .expires, .date-expires",
    "specialty": ".specialty, .specialization, .practice-area",
    "board_actions": ".board-actions, .disciplinary-actions, .actions",
    "error_message": ".error, .message, .alert",
    "no_results": ".no-results, .not-found, .no-matches",
}

# -- fixed values: document field patterns ------------------------------------------

DOCUMENT_PATTERNS = {
    "name": [
        r"(?i)(?:name|physician|doctor|provider)[\s:]*([A-Za-z\s.,]+)",
        r"(?i)^([A-Za-z\s.,]+)(?:\s*MD|\s*DO|\s*Dr\.?)",
        r"(?i)Dr\.?\s*([A-Za-z\s.,]+)",
    ],
    "address": [
        r"(?i)(?:address|location)[\s:]*([0-9]+\s+[A-Za-z0-9\s.,-]+)",
        r"([0-9]+\s+[A-Za-z0-9\s.,-]+(?:\s+St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive))",
    ],
    "phone": [
        r"(?i)(?:phone|telephone|tel)[\s:]*([0-9\-\(\)\s\+\.]+)",
        r"(\([0-9]{3}\)\s*[0-9]{3}-[0-9]{4})",
        r"([0-9]{3}-[0-9]{3}-[0-9]{4})",
        r"([0-9]{3}\.[0-9]{3}\.[0-9]{4})",
    ],
    "license": [
        r"(?i)(?:license|lic\.?|license number)[\s:]*([A-Z0-9\-]+)",
        r"(?i)(?:medical license|physician license)[\s:]*([A-Z0-9\-]+)",
        r"(?i)(?:npi|national provider identifier)[\s:]*([0-9]{10})",
    ],
    "email": [
        r"(?i)(?:email|e-mail)[\s:]*([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
        r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
    ],
    "specialty": [
        r"(?i)(?:specialty|specialization|practice area)[\s:]*([A-Za-z\s&,-]+)",
        r"(?i)(?:board certified|certification)[\s:]*([A-Za-z\s&,-]+)",
    ],
}
ENTITY_FIELDS = {
    "person": "name",
    "address": "address",
    "phone_number": "phone",
    "email_address": "email",
}
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "tiff", "bmp", "gif"]

# -- fixed values: privacy ---------------------------------------------------------

# column -> (kind of mask, sensitivity, permission, reveals allowed per hour)
PII_FIELDS = {
    "phone_primary": ("phone", "medium", "pii:reveal:phone", 20),
    "phone_alt": ("phone", "medium", "pii:reveal:phone", 20),
    "email": ("email", "medium", "pii:reveal:email", 50),
    "npi_number": ("npi", "high", "pii:reveal:npi", 10),
    "ssn": ("ssn", "critical", "pii:reveal:ssn", 5),
    "address_street": ("address", "low", "pii:reveal:address", 100),
    "given_name": ("name", "low", "pii:reveal:name", 200),
    "family_name": ("name", "low", "pii:reveal:name", 200),
    "date_of_birth": ("date_of_birth", "medium", "pii:reveal:dob", 10),
    "medical_record_number": ("medical_record_number", "critical", "pii:reveal:mrn", 5),
}
DISCLOSURE_REASONS = [
    "audit_review", "compliance_investigation", "data_correction", "customer_service",
    "legal_requirement", "medical_emergency", "system_maintenance", "other",
]
# role -> (reasons, sensitivity levels); an unknown role is a viewer
ACCESS_POLICIES = {
    "admin": (DISCLOSURE_REASONS, ["low", "medium", "high", "critical"]),
    "reviewer": (
        ["audit_review", "data_correction", "customer_service", "other"],
        ["low", "medium"],
    ),
    "auditor": (["audit_review", "compliance_investigation"], ["low", "medium", "high"]),
    "operator": (["data_correction", "customer_service"], ["low"]),
    "viewer": ([], []),
}
REDACTED = "***REDACTED***"
SECRET_KEYS = ["api_key", "password", "token", "secret"]
SENSITIVE_HEADERS = [
    "authorization", "cookie", "x-api-key", "x-auth-token",
    "x-csrf-token", "x-forwarded-for", "x-real-ip",
]

# -- fixed values: audit risk -------------------------------------------------------

RISK_ACTIONS = {
    "low": [
        "provider.read", "validation.review", "audit.read", "system.startup", "system.shutdown",
    ],
    "medium": [
        "auth.login", "auth.logout", "provider.create", "provider.update", "validation.run",
        "validation.approve", "validation.reject", "data.export", "api.call",
    ],
    "high": [
        "auth.login_failed", "auth.password_change", "provider.delete", "pii.reveal", "pii.export",
        "admin.user_create", "admin.user_update", "admin.role_change", "admin.permission_change",
        "admin.config_change", "data.import", "data.backup", "data.restore", "api.rate_limit",
    ],
    "critical": [
        "auth.token_revoke", "admin.user_delete", "data.delete", "system.error", "api.error",
    ],
}
DEFAULT_RISK = "medium"

# -- fixed values: hostile-input patterns ----------------------------------------------

XSS_PATTERNS = [
    r"<script[^>]*>.*?</script>", r"javascript:", r"vbscript:",
    r"onload\s*=", r"onerror\s*=", r"onclick\s*=", r"onmouseover\s*=",
    r"<iframe[^>]*>", r"<object[^>]*>", r"<embed[^>]*>", r"<link[^>]*>",
    r"<meta[^>]*>", r"<style[^>]*>",
    r"expression\s*\(", r"url\s*\(", r"@import",
    r"<.*?on\w+\s*=", r"<.*?style\s*=", r"<.*?href\s*=", r"<.*?src\s*=",
]
SQL_PATTERNS = [
    r"union\s+select", r"drop\s+table", r"delete\s+from", r"insert\s+into", r"update\s+set",
    r"exec\s*\(", r"execute\s*\(", r"sp_", r"xp_", r"--", r"/\*.*?\*/", r";.*?--",
    r"waitfor\s+delay", r"benchmark\s*\(", r"sleep\s*\(", r"char\s*\(", r"ascii\s*\(",
    r"ord\s*\(", r"length\s*\(", r"substring\s*\(", r"mid\s*\(", r"left\s*\(", r"right\s*\(",
    r"concat\s*\(", r"group_concat\s*\(", r"information_schema", r"sys\.", r"master\.",
    r"@@version", r"@@hostname", r"@@datadir", r"@@basedir",
]
PATH_PATTERNS = [
    r"\.\./", r"\.\.\\", r"\.\.%2f", r"\.\.%5c", r"%2e%2e%2f", r"%2e%2e%5c",
    r"\.\.%252f", r"\.\.%255c", r"\.\.%c0%af", r"\.\.%c1%9c", r"\.\.%c1%pc",
    r"\.\.%e0%80%af", r"\.\.%f0%80%80%af",
]

# -- fixed values: histogram bounds -------------------------------------------------------

BUCKETS = {
    "validation_seconds": [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0],
    "confidence": [0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0],
    "queue_seconds": [1, 5, 10, 30, 60, 300, 600, 1800],
    "api_seconds": [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0],
    "external_seconds": [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0],
    "database_seconds": [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0],
}

# -- fixed values: alert rules -------------------------------------------------------------

# name -> (condition over a metrics row, severity, cooldown minutes)
ALERT_RULES = {
    "high_manual_review_queue": ("manual_review_queue_length > 50", "warning", 30),
    "critical_manual_review_queue": ("manual_review_queue_length > 100", "critical", 15),
    "low_validation_rate": ("provider_validations_per_second < 0.1", "warning", 60),
    "high_failure_rate": ("failure_rate > 0.1", "critical", 15),
    "no_active_workers": ("validation_workers_active = 0", "critical", 5),
    "low_confidence_rate": ("provider_high_confidence_percentage < 70", "warning", 120),
    "high_external_api_errors": ("external_api_error_rate > 0.05", "warning", 30),
    "security_events": ("security_events_total > 0", "critical", 5),
    "database_connection_issues": ("database_connections_active = 0", "critical", 5),
}
# name -> (condition, severity, minutes it must hold)
SUSTAINED_RULES = {
    "HighManualReviewQueue": ("manual_review_queue_length > 50", "warning", 5),
    "CriticalManualReviewQueue": ("manual_review_queue_length > 100", "critical", 2),
    "LowValidationRate": ("provider_validations_per_second < 0.1", "warning", 10),
    "NoActiveWorkers": ("validation_workers_active = 0", "critical", 1),
    "HighJobFailureRate": ("failed_jobs_rate > 0.1", "critical", 5),
    "LowHighConfidenceRate": ("provider_high_confidence_percentage < 70", "warning", 15),
    "HighValidationLatency": ("validation_seconds_p95 > 30", "warning", 5),
    "HighExternalAPIErrorRate": ("external_api_errors_rate > 0.05", "warning", 5),
    "SecurityEvents": ("security_events_increase > 0", "critical", 0),
    "DatabaseConnectionIssues": ("database_connections_active = 0", "critical", 1),
    "LowDataQualityScore": ("data_quality_score < 0.7", "warning", 10),
    "HighComplianceViolations": ("compliance_violations_increase > 5", "warning", 5),
}

# -- fixed values: retention ----------------------------------------------------------------

# policy -> (days, action)
RETENTION_POLICIES = {
    "provider_data": (2555, "archive"),
    "audit_logs": (3650, "archive"),
    "validation_results": (1825, "archive"),
    "temp_files": (30, "delete"),
    "raw_scans": (90, "delete"),
    "backup_files": (30, "delete"),
    "cache_data": (7, "delete"),
    "session_data": (1, "delete"),
    "log_files": (90, "compress"),
}
AUDIT_RETENTION_DAYS = 2555

# -- fixed values: request limits -------------------------------------------------------------

# connector -> (requests per second, requests per minute)
CONNECTOR_LIMITS = {
    "npi_registry": (10.0, 600),
    "google_places": (10.0, 600),
    "google_document_ai": (10.0, 600),
    "hospital_website": (0.5, 30),
    "state_board": (0.5, 30),
    "enrichment": (2.0, 120),
}
# span in seconds -> requests allowed in one fixed span
REQUEST_LIMITS = {60: 60, 3600: 1000, 86400: 10000}
BURST_SECONDS, BURST_LIMIT = 10, 10

# -- fixed values: export -----------------------------------------------------------------------

EXPORT_COLUMNS = [
    "ID", "NPI", "First Name", "Last Name", "Middle Name", "Suffix",
    "Specialty", "Organization", "Organization NPI", "Email", "Phone",
    "Address Line 1", "Address Line 2", "City", "State", "ZIP Code",
    "Country", "License Number", "License State", "License Expiry",
    "Status", "Validation Score", "Last Validated", "Created At", "Updated At",
]
