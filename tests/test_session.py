from ledgerlift.session import SETTINGS, configure


class Recorder(dict):
    def config(self, key, value):
        self[key] = value
        return self


def test_settings_and_partitions_follow_the_volume():
    assert configure(Recorder()) == SETTINGS
    assert configure(Recorder(), shuffle_bytes=10 * 1024**4)["spark.sql.shuffle.partitions"] == "81920"
    assert configure(Recorder(), shuffle_bytes=1)["spark.sql.shuffle.partitions"] == "64"
