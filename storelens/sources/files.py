"""Call lists, campaign files, metadata and the campaign log."""
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.sources import folders

# The columns of the campaign files.
EMAIL_FILE = ["customer_id", "customer_name", "city", "send_to", "code", "subject", "message"]
LOG = ("time string, channel string, recipients bigint, discount string, value_at_risk bigint, status string, "
       "campaign string")
SMS_FILE = [c for c in EMAIL_FILE if c != "subject"]


def write_csv(rows: DataFrame, folder: str, columns: list[str] | None = None) -> None:
    """CSV parts with a header, quoted so that line breaks inside a message survive.

    Rows keep their order across the parts, which sort by name.
    """
    (rows.select(*(columns or rows.columns)).write.mode("overwrite")
     .option("header", True).option("escape", '"').csv(folder))


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", True).csv(folder))


def write_campaign(messages: DataFrame, folder: str, channel: str) -> None:
    write_csv(messages, folder, EMAIL_FILE if channel == "Email" else SMS_FILE)


def write_metadata(row: DataFrame, folder: str) -> None:
    row.write.mode("overwrite").json(folder)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata from a written folder or from an indented JSON file."""
    return spark.read.option("multiLine", True).json(path)


def append_log(entry: DataFrame, folder: str, campaign: str) -> bool:
    """Add a campaign to the log once; false if it was there.

    Every campaign has a folder of its own, named by its key, which appears whole. An append that is repeated, after
    a failure or by a second sender, finds it and adds nothing.
    """
    if not re.fullmatch(r"[\w.-]+", campaign) or campaign.startswith((".", "_")):
        raise ValueError(f"not a key for a campaign: {campaign!r}")
    return folders.appear(entry.sparkSession, f"{folder}/campaign={campaign}",
                          lambda aside: entry.coalesce(1).write.parquet(aside))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The campaign history, newest first; of one minute by key. Of lines that share a key one counts."""
    return (spark.read.schema(LOG).parquet(folder).dropDuplicates(["campaign"])
            .orderBy(F.desc("time"), "campaign"))
