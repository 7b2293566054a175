"""Small invented inputs; the expected results in the tests are worked by hand."""

import json


def _alert(number, time, rule, level, description, groups, agent, data):
    name, ip = agent
    return {
        "id": str(7300 + number), "timestamp": f"2025-03-04T{time}.000Z",
        "rule": {"id": rule, "level": level, "description": description, "groups": groups},
        "agent": {"id": f"9{number}", "name": name, "ip": ip}, "data": data, "location": "sensor",
    }


GATE, FILES, BUILD = ("edge-gw", "172.20.4.10"), ("files-02", "172.20.4.31"), ("build-07", "172.20.4.55")

SIEM_ALERTS = [
    _alert(1, "08:15:30", "40111", 11, "Repeated SSH logins refused", ["sshd", "invalid_login"], GATE,
           {"srcip": "192.0.2.77", "attempt_count": 56}),
    _alert(2, "09:05:00", "531", 4, "Volume nearly full", ["disk"], FILES, {"extra": {"volume": "data"}}),
    _alert(3, "10:40:00", "510", 14, "Kernel rootkit trace", ["rootcheck"], BUILD, {}),
    _alert(4, "11:20:00", "2501", 6, "Password rejected for user", ["authentication_failures", "pam"], GATE,
           {"srcip": "198.51.100.9"}),
    _alert(5, "12:30:00", "553", 8, "File removed from watched folder", ["syscheck"], FILES, {}),
]

# level, groups: two of each band
DASHBOARD = [
    (13, ["worm", "host"]), (12, ["worm", "mail"]), (11, ["web"]), (8, ["dns"]), (7, ["vpn"]),
    (4, ["usb"]), (3, ["cron"]), (0, ["host"]),
]

TECHNIQUES = [
    ("T1110", "Brute Force", "Guessing passwords: one source tries many logins over SSH until a guess is right."),
    ("T1091", "Removable Media", "A program copies itself to USB sticks and starts on the next machine."),
    ("T1048", "Other Channel", "Stolen archives leave the network through name queries or mail."),
    ("T1053", "Planned Task", "A job of the scheduler starts the intruder's program every night."),
    ("T1014", "Rootkit", "Drivers that hide files, processes and sockets from the owner of a machine."),
]


def write_lines(path, alerts):
    path.write_text("".join(json.dumps(a) + "\n" for a in alerts), encoding="utf-8")
    return str(path)
