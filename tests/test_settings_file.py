import json
import os

from shoal.sources import settings_file


def test_load_and_save(spark, tmp_path):
    path = str(tmp_path / "conf" / "settings.json")
    assert settings_file.load(spark, path)["fontSize"] == 14
    settings_file.save(spark, path, {"fontSize": 20})
    settings_file.save(spark, path, {"theme": "Dracula", "evil": 1})
    got = settings_file.load(spark, path)
    assert (got["fontSize"], got["theme"]) == (20, "Dracula") and "evil" not in json.load(open(path))
    assert settings_file.save(spark, path, {"fontSize": "huge"})["fontSize"] == 14
    assert os.stat(path).st_mode & 0o777 == 0o600
    assert os.listdir(os.path.dirname(path)) == ["settings.json"]
    open(path, "w").write("{broken")
    assert settings_file.load(spark, path)["fontSize"] == 14
    table = settings_file.settings_table(spark, [os.path.dirname(path)]).collect()
    assert len(table) == 1 and table[0].settings.scrollback == 10000
