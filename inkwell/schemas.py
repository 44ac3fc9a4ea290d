"""Declared schemas. JSON is never inferred."""

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])

USAGE = T.StructType(
    [
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("reasoning_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
    ]
)

RESULT_LINE = T.StructType(
    [
        T.StructField("custom_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("usage", USAGE),
        T.StructField("choices", T.ArrayType(T.StructType([T.StructField("message", MESSAGE)]))),
        # Present on results that were parsed once already.
        T.StructField("content", T.StringType()),
    ]
)

ERROR_LINE = T.StructType(
    [
        T.StructField("custom_id", T.StringType()),
        T.StructField(
            "error",
            T.StructType([T.StructField("type", T.StringType()), T.StructField("message", T.StringType())]),
        ),
    ]
)

REQUEST_BODY = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("reasoning_effort", T.StringType()),
        T.StructField("response_format", T.StructType([T.StructField("type", T.StringType())])),
    ]
)

REQUEST_LINE = T.StructType(
    [
        T.StructField("custom_id", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("body", REQUEST_BODY),
    ]
)

# Results and errors of a batch are child tables keyed by batch_id, so that a
# scan over batch status never reads them.
BATCH = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("request_count", T.LongType()),
        T.StructField("last_updated", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

BATCH_RECORD = T.StructType(
    BATCH.fields
    + [
        T.StructField("results", T.ArrayType(RESULT_LINE)),
        T.StructField("errors", T.ArrayType(ERROR_LINE)),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

STORE_LINE = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("response", RESULT_LINE)])

FILE_METADATA = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("lines", T.LongType()),
        T.StructField("characters", T.LongType()),
        T.StructField("words", T.LongType()),
        T.StructField("classes", T.LongType()),
        T.StructField("functions", T.LongType()),
        T.StructField("extension", T.StringType()),
        T.StructField("pages", T.LongType()),
        T.StructField("paragraphs", T.LongType()),
        T.StructField("tables", T.LongType()),
        T.StructField("has_images", T.BooleanType()),
        T.StructField("rows", T.LongType()),
        T.StructField("columns", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
        T.StructField("has_images", T.BooleanType()),
    ]
)

BLOCK = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
