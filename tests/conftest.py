import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from codeaudit.session import session_builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        session_builder("codeaudit-tests").master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tree(spark):
    """Build a files table from `{path: content}` dicts, one per repository."""

    def build(**repos):
        rows = [
            (repo, path, content)
            for repo, files in repos.items() for path, content in files.items()
        ]
        return spark.createDataFrame(rows, "repo string, path string, content string")

    return build


@pytest.fixture
def finding_rows(spark):
    """Build findings from short tuples `(review, agent, severity, file, line)`."""
    agents = ("security", "quality", "test-gap", "documentation")

    def build(rows):
        full = [
            (review, "r", agent, agents.index(agent), f"R{severity}", severity, f"title {n}", file, line, "", n)
            for n, (review, agent, severity, file, line) in enumerate(rows)
        ]
        return spark.createDataFrame(
            full,
            "review_id string, repo string, agent string, agent_ord int, rule string, severity int, "
            "title string, file string, line int, detail string, seq long",
        )

    return build
