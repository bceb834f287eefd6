"""Binary files that tasks write to and read from the shared folder."""

from __future__ import annotations

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI (file:, hdfs:, s3:, gs: ...) or plain path."""
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, name: str, parts) -> str:
    """Writes the byte strings of parts as one file and returns its name.

    The name should be of one task attempt: a repeated attempt writes another
    file, and only the name that the successful attempt returned is read.
    """
    system, top = open_folder(uri)
    system.create_dir(top, recursive=True)
    with system.open_output_stream(f"{top}/{name}", compression=None) as out:
        for p in parts:
            out.write(p)
    return name


def read_file(uri: str, name: str):
    """A random-access file."""
    system, top = open_folder(uri)
    return system.open_input_file(f"{top}/{name}")


def reader(uri: str):
    """read(at, n) and the length of a file named by a URI, for files of which little is needed."""
    # readers of Spark write one slash where a URI has three
    system, name = open_folder(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    f = system.open_input_file(name)

    def read(at: int, n: int) -> bytes:
        f.seek(min(at, f.size()))
        return f.read(n)

    return read, f.size()
