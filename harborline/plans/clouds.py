"""Clouds that nodes run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborline.session import local_table

# Clouds with a provisioning adapter, in the order test inputs number them.
CLOUDS = [
    "hetzner", "scw", "aws", "gcp", "linode", "azure", "upcloud", "vultr",
    "do", "ibm", "exoscale", "alibaba", "oracle", "tencent", "selectel",
]

# Login of the clouds whose machines can be reached. The logins of gcp and
# azure are accounts of a site, so they come from the caller.
SSH_USERS = {
    "ibm": "root", "do": "root", "scw": "root", "linode": "root",
    "upcloud": "root", "hetzner": "root", "aws": "root", "vultr": "root",
    "exoscale": "ubuntu",
}
SITE_LOGIN_CLOUDS = ["gcp", "azure"]

# Clouds where commands keep their `sudo`.
SUDO_CLOUDS = ["gcp", "azure", "exoscale"]


def cloud_registry(spark: SparkSession, site_users: dict[str, str]) -> DataFrame:
    """One row per cloud with an adapter: its name and SSH login, null when unreachable."""
    missing = [cloud for cloud in SITE_LOGIN_CLOUDS if cloud not in site_users]
    if missing:
        raise ValueError(f"site_users has no login for {', '.join(missing)}")
    users = {**SSH_USERS, **{cloud: site_users[cloud] for cloud in SITE_LOGIN_CLOUDS}}
    rows = [(cloud, cloud, users.get(cloud)) for cloud in CLOUDS]
    return local_table(spark, rows, "cloud string, adapter string, ssh_user string")
