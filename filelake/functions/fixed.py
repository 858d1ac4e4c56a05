"""Fixed values of the file-catalogue rules."""

# Media extensions, ignore patterns, corruption markers, MIME groups, statuses, protected folders.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "heic", "raw", "cr2", "nef", "arw", "dng"]
VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "mkv", "webm", "mts", "m4v", "3gp"]
IGNORE_PATTERNS = ["Thumbs.db", ".DS_Store", "desktop.ini", "._*", ".cache", ".tmp", ".temp"]
CORRUPTION_MARKERS = ["truncated", "corrupt", "premature", "missing eoi", "bogus", "extraneous bytes"]
IMAGE_MIN_BYTES = 10 * 1024
VIDEO_MIN_BYTES = 100 * 1024
PARTIAL_BYTES = 65536
REPORT_FOLDERS = ["_skipped", "_failures", "_duplicates"]
FOLDER_PATTERNS = {"YYYY_MM": "yyyy/MM", "YYYY_MMM": "yyyy/MMM", "YYYY_MMM_DD": "yyyy/MMM/dd", "YYYY_MM_DD": "yyyy/MM/dd"}
STATUSES = ["INTACT", "MISSING", "RESIZED", "CORRUPTED", "UNREADABLE", "UNTRACKED", "UNVERIFIABLE"]
PROBLEM_STATUSES = ["MISSING", "RESIZED", "CORRUPTED", "UNREADABLE"]
VERIFIED_STATUSES = ["INTACT", *PROBLEM_STATUSES]
PROTECTED_FOLDERS = ["/System", "/Library", "/usr", "/bin", "/sbin", "/etc", "/var", "/boot", "/dev", "/proc", "/Applications"]
MIME_GROUPS = [
    ("PROTECTED_MEDIA", "Protected media", False, ["image/", "video/"], []),
    ("ANDROID_PACKAGE", "Android packages", True, [], ["application/vnd.android.package-archive"]),
    ("EXECUTABLE", "Executables and installers", True, [], [
        "application/x-msdownload", "application/x-dosexec", "application/vnd.microsoft.portable-executable", "application/x-executable",
        "application/x-sharedlib", "application/x-mach-binary", "application/x-ms-installer", "application/x-msi",
        "application/vnd.ms-cab-compressed", "application/x-elf", "application/x-sh", "application/x-bat", "application/x-msdos-program",
    ]),
    ("ARCHIVE", "Archives", True, [], [
        "application/zip", "application/x-rar-compressed", "application/vnd.rar", "application/x-7z-compressed", "application/gzip",
        "application/x-gzip", "application/x-tar", "application/x-bzip2", "application/x-xz", "application/java-archive",
    ]),
    ("DOCUMENT", "Documents", True, ["text/"], [
        "application/pdf", "application/msword", "application/rtf", "application/vnd.ms-excel", "application/vnd.ms-powerpoint",
        "application/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.spreadsheet",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ]),
    ("AUDIO", "Audio", True, ["audio/"], []),
    ("OTHER", "Other non-media", True, [], []),
]
