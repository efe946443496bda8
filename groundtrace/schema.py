"""Event schema, allow-list and spelling variants of the process-event records."""

from pyspark.sql import types as T

# --- Fixed values: production fields (the allow-list of the sanitiser) --------------------------
FIELDS = {
    "EventID": "int",
    "EventTime": "string",
    "UtcTime": "string",
    "Hostname": "string",
    "Channel": "string",
    "Image": "string",
    "SourceImage": "string",
    "CommandLine": "string",
    "ProcessId": "bigint",
    "ProcessGUID": "string",
    "ParentImage": "string",
    "ParentProcessId": "bigint",
    "ParentProcessGUID": "string",
    "ParentCommandLine": "string",
    "User": "string",
    "Domain": "string",
    "AccountName": "string",
    "IntegrityLevel": "string",
    "LogonId": "string",
    "SourcePort": "int",
    "DestinationIp": "string",
    "DestinationPort": "int",
    "DestinationHostname": "string",
    "Protocol": "string",
    "TargetFilename": "string",
    "TargetObject": "string",
    "EventType": "string",
    "CreationUtcTime": "string",
    "CurrentDirectory": "string",
    "Hashes": "string",
    "Company": "string",
    "Description": "string",
    "Product": "string",
    "Version": "string",
    "OriginalFileName": "string",
    "FileVersion": "string",
    "Signed": "string",
    "Signature": "string",
    "SignatureStatus": "string",
}
ALLOWED_FIELDS = tuple(FIELDS)
NUMBER_FIELDS = {name: kind for name, kind in FIELDS.items() if kind != "string"}

# --- Fixed values: training metadata ------------------------------------------------------------
LABEL_FIELD = "_label"
TECHNIQUE_FIELD = "_attack_technique"
SOURCE_FIELD = "_source"
PROMPT_FIELD = "prompt"
# Field of the input records that holds the reviewer's verdict; renamed to ``reviewer`` on reading.
REVIEWER_SOURCE_FIELD = "claude-sonnet-4-5"
REVIEWER = "reviewer"
REVIEWER_TYPE = T.StructType([
    T.StructField("predicted_label", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("attack_technique", T.StringType()),
])

# --- Fixed values: camelCase spellings accepted for a field --------------------------------------
# Column names are case-insensitive in Spark SQL, so a variant travels under ``alt_<spelling>``.
SPELLINGS = {
    "CommandLine": "commandLine",
    "Image": "image",
    "ParentImage": "parentImage",
    "ParentCommandLine": "parentCommandLine",
    "User": "user",
    "Domain": "domain",
    "AccountName": "accountName",
    "EventTime": "eventTime",
    "ProcessId": "processId",
    "ParentProcessId": "parentProcessId",
    "IntegrityLevel": "integrityLevel",
}


def alt(field: str) -> str:
    """Name of the column that carries the other spelling of ``field``."""
    return "alt_" + SPELLINGS[field]


def raw_event_schema(with_spellings: bool = False) -> T.StructType:
    """Schema of one JSON record. Numbers are read as text because they occur quoted and bare."""
    fields = [T.StructField(name, T.StringType()) for name in ALLOWED_FIELDS]
    fields += [T.StructField(name, T.StringType())
               for name in (LABEL_FIELD, TECHNIQUE_FIELD, SOURCE_FIELD, PROMPT_FIELD)]
    fields.append(T.StructField(REVIEWER_SOURCE_FIELD, REVIEWER_TYPE))
    if with_spellings:
        fields += [T.StructField(name, T.StringType()) for name in SPELLINGS.values()]
    return T.StructType(fields)


def sanitized_schema() -> T.StructType:
    """Typed schema of a sanitised event."""
    numbers = {"int": T.IntegerType(), "bigint": T.LongType()}
    return T.StructType([
        T.StructField(name, numbers[NUMBER_FIELDS[name]] if name in NUMBER_FIELDS else T.StringType())
        for name in ALLOWED_FIELDS
    ])
