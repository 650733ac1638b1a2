"""Reading a vault of many folders takes a bounded number of tasks and finds every file once."""

import pytest

from gleaner.sources import note_files as files


@pytest.mark.parametrize("novels", [0, 3, 500])
def test_tasks_are_bounded_and_files_are_found_once(tmp_path, novels):
    want = {"top.md"} | {f"novel {i}/000{n} - x.md" for i in range(novels) for n in range(1, 4)} | {f"novel {i}/deep/er/y.md" for i in range(0, novels, 7)}
    for name in [*want, "novel 1/skip.txt", "_writing/job/a.md", "novel 2/_writing/b.md"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "link").symlink_to(tmp_path / "novel 1")
    (tmp_path / "folder.md").mkdir()
    reader = files.NoteReader(str(tmp_path), ".md", True)
    tasks = reader.partitions()
    assert len(tasks) <= 256
    found = [row for task in tasks for row in reader.read(task)]
    assert sorted(found) == sorted((p, p) for p in want)
    assert files.NoteReader(str(tmp_path / "none"), ".md", True).partitions() == []
