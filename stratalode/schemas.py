"""Table schemas of the catalogue, as DDL and StructTypes, and its fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = {
    "unit_descriptors": "id long, project string, version int, source_kind string, path string, size_bytes long, content_hash string",
    "unit_snapshots": "id long, descriptor_id long, unit_name string",
    "unit_constants": "id long, snapshot_id long, constant_value string, constant_value_type string",
    "constant_usages": (
        "id long, constant_id long, structural_type string, semantic_type_kind string, semantic_type_name string, semantic_display_name string, "
        "semantic_description string, location_class_name string, location_method_name string, location_method_descriptor string, "
        "location_bytecode_offset int, location_line_number int, confidence double, metadata string"
    ),
    "project_versions": "id long, project string, version int, parent_version int, status string, created_at timestamp_ntz, finalized_at timestamp_ntz",
    "version_deletions": "id long, project string, version int, unit_path string, deleted_at timestamp_ntz",
    "index_outbox": "id long, created_at timestamp, project string, unit_path string, version int, payload_json string, attempts int, last_error string, next_attempt_at timestamp",
    "index_outbox_dead": "id long, failed_at timestamp, project string, unit_path string, version int, payload_json string, last_error string",
    "archive_jobs": (
        "id long, project string, version int, jar_name string, status string, started_at timestamp, last_updated_at timestamp, "
        "nested_total int, nested_processed int, nested_failed int, error_message string"
    ),
}

#: Rows that extraction gives, one per usage.
USAGE = (
    "path string, source_kind string, unit_name string, value string, value_type string, structural_type string, semantic_type string, confidence double, "
    "class_name string, method_name string, method_descriptor string, bytecode_offset int, line_number int, metadata string, error string"
)


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


# Fixed values.
STRUCTURAL_TYPES = (
    "ARITHMETIC_OPERAND",
    "STRING_CONCATENATION_MEMBER",
    "STATIC_FIELD_STORE",
    "FIELD_STORE",
    "METHOD_INVOCATION_TARGET",
    "METHOD_INVOCATION_PARAMETER",
    "ANNOTATION_VALUE",
)

# Name, category, display name, description.
CORE_SEMANTIC_TYPES = (
    ("SQL_FRAGMENT", "database", "SQL Fragment", "SQL query or statement"),
    ("URL_RESOURCE", "network", "URL Resource", "HTTP/HTTPS URL"),
    ("FILE_PATH", "filesystem", "File Path", "Filesystem path"),
    ("PROPERTY_KEY", "config", "Property Key", "Configuration property name"),
    ("REGEX_PATTERN", "text", "Regex Pattern", "Regular expression"),
    ("LOG_MESSAGE", "logging", "Log Message", "Log message template"),
    ("ERROR_MESSAGE", "error", "Error Message", "Error or exception message"),
    ("CONFIGURATION_VALUE", "config", "Configuration Value", "Configuration value"),
    ("API_ENDPOINT", "network", "API Endpoint", "REST API endpoint path"),
    ("DATE_FORMAT", "datetime", "Date Format", "Date/time format string"),
    ("ENCODING_NAME", "text", "Encoding Name", "Character encoding name"),
    ("MIME_TYPE", "network", "MIME Type", "MIME type identifier"),
    ("HTML_CONTENT", "web", "HTML Content", "HTML markup"),
    ("JSON_KEY", "data", "JSON Key", "JSON object key"),
    ("UNKNOWN", "unknown", "Unknown", "Could not classify"),
)

# Fixed values.
VALUE_TYPES = (
    "String",
    "Integer",
    "Long",
    "Float",
    "Double",
    "Boolean",
    "Byte",
    "Short",
    "Character",
    "Null",
    "DynamicConstant",
    "ClassDescriptor",
    "ArrayDesc",
    "MethodHandle",
)


def core_semantic_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORE_SEMANTIC_TYPES, "name string, category string, display_name string, description string")
