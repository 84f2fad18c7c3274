"""Files in the folder that the driver and all executors share."""

from specmatch.shared_files import local, mapped, write  # noqa: F401
