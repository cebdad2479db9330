from dataclasses import dataclass


@dataclass
class Entry:
    key: str


class Repository(Entry):
    """Keeps entries."""

    def save(self, entry):
        self.connection.execute("insert", entry)
        self.connection.commit()

    @property
    def size(self):
        return len(self.entries)

    def parse(self, text):
        def inner():
            return split(text)

        return inner()
