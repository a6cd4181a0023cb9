"""Semantic classification: rules as tables that are joined by callee, and ordered rules for configuration values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Classes and methods of each rule, with its confidence.
LOGGERS = ("org.slf4j.Logger", "org.apache.logging.log4j.Logger", "org.apache.log4j.Logger", "java.util.logging.Logger", "ch.qos.logback.classic.Logger")
PRINTERS = ("java.io.PrintStream", "java.io.PrintWriter")
LOG_METHODS = ("trace", "debug", "info", "warn", "error", "fatal", "log", "logp", "logrb", "println", "print")
JDBC = ("java.sql.Statement", "java.sql.PreparedStatement", "java.sql.CallableStatement", "java.sql.Connection")
JDBC_METHODS = ("executeQuery", "executeUpdate", "execute", "prepareStatement", "prepareCall", "nativeSQL")
JPA = ("javax.persistence.EntityManager", "jakarta.persistence.EntityManager")
JPA_METHODS = ("createQuery", "createNativeQuery", "createNamedQuery")
SPRING_JDBC = ("org.springframework.jdbc.core.JdbcTemplate", "org.springframework.jdbc.core.namedparam.NamedParameterJdbcTemplate")
SPRING_JDBC_METHODS = ("query", "queryForObject", "queryForList", "queryForMap", "queryForRowSet", "update", "batchUpdate", "execute")
CHECKS = ("java.util.Objects", "com.google.common.base.Preconditions")
CHECK_METHODS = ("requireNonNull", "checkArgument", "checkState", "checkNotNull")
ERROR_ENDINGS = ("Exception", "Error", "Throwable")
OLD_FILES = ("java.io.File", "java.io.FileInputStream", "java.io.FileOutputStream", "java.io.FileReader", "java.io.FileWriter")
NEW_FILES = ("java.nio.file.Path", "java.nio.file.Paths", "java.nio.file.Files", "java.nio.file.FileSystems")
FILE_METHODS = (
    "<init>", "of", "get", "resolve", "resolveSibling", "readString", "writeString", "readAllLines", "newInputStream", "newOutputStream",
    "newBufferedReader", "newBufferedWriter", "createFile", "createDirectory", "createDirectories", "delete", "deleteIfExists", "move", "copy",
)
URLS = ("java.net.URL", "java.net.URI", "java.net.http.HttpRequest", "java.net.http.HttpClient")
URL_METHODS = ("<init>", "create", "of", "newBuilder", "uri", "GET", "POST", "PUT", "DELETE")
HTTP_CLIENTS = (
    "org.apache.http.client.methods.HttpGet",
    "org.apache.http.client.methods.HttpPost",
    "org.apache.http.client.methods.HttpPut",
    "org.apache.http.client.methods.HttpDelete",
    "okhttp3.Request.Builder",
    "org.springframework.web.reactive.function.client.WebClient",
    "org.springframework.web.client.RestTemplate",
)
HTTP_CLIENT_METHODS = ("<init>", "uri", "url", "getForObject", "getForEntity", "postForObject", "postForEntity", "exchange", "delete", "put")
ENDPOINT_ANNOTATIONS = (
    "org.springframework.web.bind.annotation.RequestMapping",
    "org.springframework.web.bind.annotation.GetMapping",
    "org.springframework.web.bind.annotation.PostMapping",
    "org.springframework.web.bind.annotation.PutMapping",
    "org.springframework.web.bind.annotation.DeleteMapping",
    "org.springframework.web.bind.annotation.PatchMapping",
    "jakarta.ws.rs.Path",
    "javax.ws.rs.Path",
)
PROPERTY_ANNOTATIONS = (
    "org.springframework.beans.factory.annotation.Value",
    "org.springframework.boot.context.properties.ConfigurationProperties",
    "jakarta.inject.Named",
    "javax.inject.Named",
)
SQL_ANNOTATIONS = (
    "jakarta.persistence.Table",
    "javax.persistence.Table",
    "jakarta.persistence.Column",
    "javax.persistence.Column",
    "jakarta.persistence.NamedQuery",
    "javax.persistence.NamedQuery",
    "jakarta.persistence.NamedNativeQuery",
    "javax.persistence.NamedNativeQuery",
)
REGEX_ANNOTATIONS = ("jakarta.validation.constraints.Pattern", "javax.validation.constraints.Pattern")

#: rule id -> semantic type, metadata keys of class and method, ((classes, methods, confidence), ...); the first part that fits gives the confidence
CALL_RULES = {
    "logging": ("LOG_MESSAGE", ("loggerClass", "loggerMethod"), ((LOGGERS, LOG_METHODS, 0.95), (PRINTERS, LOG_METHODS, 0.85), (("%Logger",), LOG_METHODS, 0.75))),
    "sql": ("SQL_FRAGMENT", ("dbClass", "dbMethod"), ((JDBC, JDBC_METHODS, 0.95), (JPA, JPA_METHODS, 0.90), (SPRING_JDBC, SPRING_JDBC_METHODS, 0.85))),
    "error": ("ERROR_MESSAGE", ("errorClass", "errorMethod"), ((tuple(f"%{e}" for e in ERROR_ENDINGS), ("<init>",), 0.95), (CHECKS, CHECK_METHODS, 0.90))),
    "file": ("FILE_PATH", ("fileClass", "fileMethod"), ((NEW_FILES, FILE_METHODS, 0.95), (OLD_FILES, FILE_METHODS, 0.90))),
    "url": ("URL_RESOURCE", ("urlClass", "urlMethod"), ((URLS, URL_METHODS, 0.95), (HTTP_CLIENTS, HTTP_CLIENT_METHODS, 0.85))),
}

#: (annotations, elements or None for any, semantic type, confidence), the first that fits
ANNOTATION_RULES = (
    (ENDPOINT_ANNOTATIONS, ("value", "path"), "API_ENDPOINT", 0.95),
    (PROPERTY_ANNOTATIONS, None, "PROPERTY_KEY", 0.95),
    (SQL_ANNOTATIONS, ("query", "value"), "SQL_FRAGMENT", 0.90),
    (SQL_ANNOTATIONS, ("name", "catalog", "schema"), "SQL_FRAGMENT", 0.85),
    (REGEX_ANNOTATIONS, ("regexp",), "REGEX_PATTERN", 0.95),
)


def _is(name: Column, patterns: tuple[str, ...]) -> Column:
    plain = [p for p in patterns if not p.startswith("%")]
    out = name.isin(plain) if plain else F.lit(False)
    for p in patterns:
        if p.startswith("%"):
            out = out | name.endswith(p[1:])
    return out


def call_rule(rule: str, callee: Column, method: Column) -> Column:
    """Confidence that a rule gives to an argument of callee.method; null if it doesn't fit."""
    _, _, parts = CALL_RULES[rule]
    out = None
    for classes, methods, confidence in parts:
        fits = _is(callee, classes) & method.isin(list(methods))
        out = F.when(fits, F.lit(confidence)) if out is None else out.when(fits, F.lit(confidence))
    return out


def classify_calls(calls: DataFrame, callee: str = "callee", method: str = "method") -> DataFrame:
    """calls with (semantic_type, confidence): a row for each rule that fits, else one of UNKNOWN and 0."""
    parts = []
    for rule, (semantic, _, _) in CALL_RULES.items():
        got = call_rule(rule, F.col(callee), F.col(method))
        parts.append(F.when(got.isNotNull(), F.struct(F.lit(semantic).alias("semantic_type"), got.alias("confidence"))))
    unknown = F.struct(F.lit("UNKNOWN").alias("semantic_type"), F.lit(0.0).alias("confidence"))
    found = F.filter(F.array(*parts), lambda x: x.isNotNull())
    rows = calls.withColumn("_found", F.when(F.size(found) > 0, found).otherwise(F.array(unknown)))
    return rows.select(*calls.columns, F.explode("_found").alias("_f")).select(*calls.columns, "_f.semantic_type", "_f.confidence")


def classify_annotation(annotation: Column, element: Column) -> Column:
    """struct(semantic_type, confidence) of an annotation's element; null if no rule fits."""
    out = None
    for names, elements, semantic, confidence in ANNOTATION_RULES:
        fits = annotation.isin(list(names))
        if elements:
            fits = fits & element.isin(list(elements))
        value = F.struct(F.lit(semantic).alias("semantic_type"), F.lit(confidence).alias("confidence"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def classify_config(value: Column, key: Column, is_text: Column | None = None) -> Column:
    """Semantic type of a configuration value: the first rule that fits, by value if it is a text, then by key."""
    text = F.lit(True) if is_text is None else is_text
    low = F.lower(key)
    has = low.contains
    return (
        F.when(text & value.rlike(r"^https?://[^\n\r\u0085  ]*$(?![\n\r])"), "URL_RESOURCE")
        .when(text & value.contains("/") & ~value.contains(" "), "FILE_PATH")
        .when(text & value.rlike(r"^\w+/\w+[^\n\r\u0085  ]*$(?![\n\r])"), "MIME_TYPE")
        .when(has("url") | has("uri"), "URL_RESOURCE")
        .when(has("path") | has("dir"), "FILE_PATH")
        .when(has("pattern") | has("regex"), "REGEX_PATTERN")
        .when(has("format") & has("date"), "DATE_FORMAT")
        .otherwise("CONFIGURATION_VALUE")
    )


def call_rule_table(spark: SparkSession) -> DataFrame:
    """(rule, semantic_type, class_pattern, method, confidence, place); a pattern with % fits by its ending."""
    rows = [
        (rule, semantic, c, m, confidence, place)
        for rule, (semantic, _, parts) in CALL_RULES.items()
        for place, (classes, methods, confidence) in enumerate(parts)
        for c in classes
        for m in methods
    ]
    return spark.createDataFrame(rows, "rule string, semantic_type string, class_pattern string, method string, confidence double, place int")
